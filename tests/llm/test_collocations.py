import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import odd_documents

from polderlake.llm import collocations as c


def brute(rows, least, longest=5, top=2_000):
    """All phrases counted one by one."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang][tuple(words[i:i + n])] += 1
    out = []
    for lang, f in counts.items():
        often = {p: n for p, n in f.items() if n >= least}
        held = {p[i:j]: 0 for p in often for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                if j - i < len(p)}
        for p, n in often.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        held[p[i:j]] = max(held[p[i:j]], n)
        rows = []
        for p, a in often.items():
            if len(p) < 2 or held.get(p, 0) >= a:
                continue
            score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k)
                           for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]]))
        out += [(lang, r, p.decode(), a, l, rr, totals[lang], -s)
                for r, (s, _, p, a, l, rr) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "éa", "İ", "\x1c", "a-b"]
    fixed = ["new York city hall", "New york", "once upon a time"]
    rows = []
    for i in range(n):
        bits = [r.choice(fixed) if r.random() < 0.3 else r.choice(words) for _ in range(r.randrange(30))]
        ends = [r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r", "\x0b"]) for _ in bits]
        rows.append((r.choice(["en", "en", "de", None, "und"]), "".join(b + e for b, e in zip(bits, ends))))
    return rows + [("en", "again again again again"), ("xx", None), (None, ""), ("en", " \t.\n")]


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, "lang string, text string")
    return sorted(map(tuple, c.collocations(spark, docs, **options).collect()))


@pytest.mark.parametrize("least,top", [(3, 2_000), (8, 15)])
def test_equals_brute_force(spark, monkeypatch, least, top):
    monkeypatch.setattr(c, "CHUNK_CHARS", 700)  # many chunks and flushes
    monkeypatch.setattr(c, "HELD", 50)
    monkeypatch.setattr(c, "WORDS_HELD", 5)
    rows = corpus(least, 150)
    assert found(spark, rows, least=least, top=top) == brute(rows, least, top=top)


def test_full_bitmaps_and_tight_summaries_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(c, "MAX_BITS", c.SEGMENT)
    monkeypatch.setattr(c, "COUNTERS", 40)
    rows = corpus(5, 150)
    monkeypatch.setattr(c, "FACTORS", c.FACTORS[:1])
    assert found(spark, rows, least=5) == brute(rows, 5)


def test_summary_keeps_every_frequent_key_and_bounds_its_count():
    r = np.random.default_rng(1)
    keys = np.concatenate([np.repeat(np.arange(40), 120), r.integers(1_000, 9_000, 40_000)]).astype(np.uint64)
    r.shuffle(keys)
    true = Counter(keys.tolist())
    s = c.Summary(len(keys) // 100 + 1)
    for part in np.array_split(keys, 77):
        s.merge(part, np.ones(len(part), np.int64))
        assert len(s.keys) <= s.capacity
    assert 0 < s.taken < 100
    assert {k for k, n in true.items() if n >= 100} <= set(s.at_least(100).tolist())
    for k, n in zip(s.keys.tolist(), s.counts.tolist()):
        assert n <= true[k] <= n + s.taken


def test_words_of_all_languages_share_one_bound(monkeypatch):
    monkeypatch.setattr(c, "WORDS_HELD", 100)
    words = c.Words(np.zeros(c.SEGMENT // 8, np.uint8))  # no word is frequent
    for i in range(40):
        words.known(f"l{i % 8}", [f"{i} {j}".encode() for j in range(60)])
        assert sum(map(len, words.by_lang.values())) <= 100 + len(words.by_lang) + 1
    frequent = c.Words(np.full(c.SEGMENT // 8, 255, np.uint8))
    ids = {lang: dict(frequent.known(lang, [b"a", b"b", c.BREAK])) for lang in "xyz"}
    for lang in "xyz":
        frequent.known(lang, [str(j).encode() for j in range(200)])
    assert all(frequent.by_lang[lang][w] == i for lang in "xyz" for w, i in ids[lang].items())


def test_merged_counts_equal_counting():
    r = np.random.default_rng(2)
    keys, counts, every = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
    for size in (0, 1, 500, 0, 3, 2_000):
        new = r.integers(0, 900, size).astype(np.uint64)
        every += new.tolist()
        keys, counts = c.merged(keys, counts, new)
        assert dict(zip(keys.tolist(), counts.tolist())) == Counter(every) and (np.diff(keys.astype(int)) > 0).all()


def test_a_phrase_that_is_most_of_the_mass(spark):
    rows = [("en", "the same words " * 400)] * 3 + corpus(9, 60)
    assert found(spark, rows, least=10) == brute(rows, 10)


def test_products_beyond_64_bits(spark):
    rows = spark.createDataFrame([(10**9, 10**13, 10**9, 10**9)], "a long, n long, l long, r long")
    wide = "cast({} as decimal(38,0))".format
    got = rows.selectExpr(f"({wide('1000')} * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})").first()[0]
    assert got == 1000 * 10**22 // 10**18


def test_odd_rows_and_empty_tables(spark):
    docs = odd_documents(spark)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    got = sorted(map(tuple, c.collocations(spark, docs, least=2).collect()))
    assert got == brute(rows, 2)
    assert c.collocations(spark, docs.limit(0)).collect() == []
