import random

from fixtures import ODD, odd_documents, plain

from polderlake.llm import decontamination as dc


def nearest(item, text):
    """Least edits between the item and any part of the text."""
    last = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        row = [i]
        for j, b in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (a != b)))
        last = row
    return min(last)


def test_myers_equals_dynamic_programming():
    r = random.Random(1)
    for _ in range(300):
        item = "".join(r.choice("ab ") for _ in range(r.randint(1, 70)))
        text = "".join(r.choice("ab ") for _ in range(r.randint(0, 60)))
        k = r.randint(0, max(0, len(item) - 1))
        masks = {}
        for i, c in enumerate(item):
            masks[c] = masks.get(c, 0) | 1 << i
        assert dc.occurs(masks, len(item), text, k) == (nearest(item, text) <= k)


def test_matcher_equals_brute_force():
    r = random.Random(2)
    make = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    items = [(i, dc.normalise(make(r.randint(24, 90)))) for i in range(12)]
    items.append((99, items[0][1]))
    matcher = dc.Matcher(items, 0.1, 12)
    for _ in range(150):
        _, item = r.choice(items)
        text = list(item)
        for _ in range(r.randint(0, 9)):
            at = r.randrange(len(text))
            text[at] = r.choice(["", "z", text[at] + "q"])
        text = dc.normalise(make(40) + "".join(text) + make(40))
        want = sorted(i for i, t in items if nearest(t, text) <= dc.budget(len(t), 0.1, 12))
        assert matcher.search(text) == want


ITEM = "Which of these is the capital of the very old kingdom in the far north of the land?"


def test_copies_go_and_clean_rows_stay(spark):
    docs = plain(spark, [(i, t) for i, t, _ in ODD] + [
        (50, "before " + ITEM.upper().replace(" ", "\n ") + " after"),
        (51, "x " + ITEM.replace("capital", "kapitol") + " y"), (52, ITEM[:30]), (53, ITEM[:40] + " else " * 9)])
    bench = spark.createDataFrame([(1, ITEM), (2, ITEM), (3, None), (4, " "), (None, "quick brown fox")],
                                  "item_id long, text string")
    got = {r.doc_id: r for r in dc.flagged(spark, docs, bench).collect()}
    assert {i for i, r in got.items() if r.contaminated} == {50, 51}
    assert got[50].item_ids == [1, 2] and got[50].n_items == 2
    left = dc.drop_contaminated(spark, docs, bench)
    assert left.count() == docs.count() - 2
    blocks = dc.flagged(spark, docs, bench, block_items=1)
    assert {(r.doc_id, *r.item_ids) for r in blocks.collect()} == {(i, *r.item_ids) for i, r in got.items()}


def test_odd_rows_and_empty_tables(spark):
    docs = odd_documents(spark)
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert dc.drop_contaminated(spark, docs, bench).columns == docs.columns
    assert dc.drop_contaminated(spark, docs, bench.limit(0)).count() == len(ODD)
    assert dc.flagged(spark, docs.limit(0), bench).collect() == []


def test_every_item_within_the_declared_rate_is_found():
    r = random.Random(5)
    make = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    items = [(i, t) for i, t in enumerate(dc.normalise(make(n)) for n in [
        *range(8, 40, 3), *range(60, 240, 20)]) if t]
    matcher, beyond = dc.Matcher(items, dc.ERROR_RATE, dc.MIN_PIECE), 0
    for _ in range(120):
        _, item = r.choice(items)
        text = list(item)
        for at in r.sample(range(len(text)), min(len(text), r.randint(0, len(item) // 9 + 1))):
            text[at] = r.choice(["", "z", text[at] + "q"])
        text = dc.normalise(make(40) + "".join(text) + make(40))
        want = sorted(i for i, t in items if nearest(t, text) <= int(0.1 * len(t)))
        beyond += any(nearest(t, text) > max(0, len(t) // 12 - 1) for i, t in items if i in want)
        assert matcher.search(text) == want
    assert beyond > 10


def test_windows_join_where_starts_overlap():
    hits = [(0, 0), (2, 8), (3, 0), (50, 0), (50, 0), (90, 8), (93, 0)]
    assert list(dc.windows(hits, 3, 2)) == [(0, 2), (90, 90)]
    assert list(dc.windows(hits, 3, 1)) == [(0, 3), (50, 50), (90, 93)]
