import random

import numpy as np
import pytest
from fixtures import ODD, odd_documents, plain

from polderlake.llm import near_dedup as nd
from polderlake.llm.components import components


def words(r, n):
    return [r.choice("abcdefghij") + str(r.randrange(400)) for _ in range(n)]


def corpus():
    """A group of near copies of one text, a passage many texts share, chains, and odd ones."""
    r = random.Random(5)
    base, passage, texts = words(r, 160), words(r, 60), []
    for _ in range(120):
        w = list(base)
        for _ in range(r.randint(0, 8)):
            w[r.randrange(160)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(words(r, r.randint(5, 60)) + passage + words(r, r.randint(5, 60))) for _ in range(40)]
    for _ in range(6):
        w = words(r, 100)
        for k in range(8):
            texts.append(" ".join(w))
            w = list(w)
            w[r.randrange(100)] = f"y{r.randrange(10**6)}"
            w += words(r, 3) if k % 2 else []
    texts += ["", "  ", "a b c", "A b  c", "a b d"]
    r.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


def brute(rows):
    hashes = nd.WordHashes()
    sets = {i: set(nd.shingles(t, hashes).tolist()) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if len(a & b) >= nd.THRESHOLD * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_classes_equal_brute_force(spark):
    rows = corpus()
    docs = plain(spark, [*rows, (None, rows[0][1]), (10**6, None)])
    got = nd.near_classes(spark, docs).collect()
    want = brute([*rows, (10**6, "")])
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    sizes = {c: list(want.values()).count(c) for c in want.values()}
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id)
               for r in got if r.doc_id is not None)
    assert nd.drop_near_copies(spark, docs).count() == len(sizes) + 1


def test_sketches_estimate_probability_jaccard():
    r = np.random.default_rng(0)
    a = r.integers(0, 2**63, 1_000).astype(np.uint64)
    b = np.concatenate([a[:900], r.integers(0, 2**63, 100).astype(np.uint64)])
    s = nd.sketches([a, b, a[:3], np.repeat(a, 3)], 960)
    assert abs((s[0] == s[1]).mean() - 900 / 1100) < 0.05
    assert (s[0] == s[3]).all() and set(s[2]) <= set(a[:3])
    assert (nd.sketches([a], 960)[0] == s[0]).all()  # batches do not matter
    assert nd.sketches([], 8).shape == (0, 8)


def test_odd_rows_and_empty_table(spark):
    docs = odd_documents(spark)
    out = nd.drop_near_copies(spark, docs)
    assert out.columns == docs.columns
    assert nd.near_classes(spark, docs).count() == len(ODD)
    assert nd.near_classes(spark, docs.limit(0)).collect() == []


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(1, 5), (5, 3), (3, 3), (7, 8)],
                                  "a long, b long")
    got = {r.node: r.component for r in components(spark, links).collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, 1: 1, 3: 1, 5: 1, 7: 7, 8: 7}
    assert components(spark, links.limit(0)).collect() == []


@pytest.mark.parametrize("times", [1, 5, 20, 60])
def test_texts_that_repeat_parts_of_themselves_meet(times):
    """Pairs of set Jaccard similarity just above 0.8, a part of one text many times over."""
    r, met, pairs = np.random.default_rng(times), 0, 400
    for _ in range(pairs):
        sets = r.integers(0, 2**63, 111, np.uint64)
        both, more = sets[:90], sets[90:]
        half = np.repeat(both[:r.integers(1, 90)], times)
        a = np.concatenate([both, half, more[:10]])
        b = np.concatenate([both, more[10:]])
        keys = nd.sketches([a, b], nd.BANDS * nd.ROWS).reshape(2, nd.BANDS, -1)
        met += bool((keys[0] == keys[1]).all(axis=1).any())
    assert met >= 0.99 * pairs
