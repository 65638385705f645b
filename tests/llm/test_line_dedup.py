import random
import re

from fixtures import ODD, odd_documents, plain
from pyspark.sql import functions as F

from polderlake.llm import line_dedup as ld


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def change(r, s, k):
    s = list(s)
    for _ in range(k):
        at = r.randrange(len(s))
        s[at] = r.choice(["", r.choice("abé😀"), s[at] + r.choice("abé😀")])
    return "".join(s)


def test_banded_distance_equals_dynamic_programming(spark):
    r = random.Random(3)
    rows = []
    for _ in range(300):
        a = "".join(r.choice("abé😀") for _ in range(r.randint(6, 30)))
        rows.append((a, change(r, a, r.randint(0, 5))))
    df = spark.createDataFrame(rows, "a string, b string")
    for k in (1, 2, 3):
        got = df.select("a", "b", ld.within(F.col("a"), F.col("b"), k).alias("near"),
                        ld.letters_allow(F.col("a"), F.col("b"), k).alias("may")).collect()
        for x in got:
            assert x.near == (edits(x.a, x.b) <= k)
            assert x.may or not x.near


def brute(rows, k=2, least=20, near=40):
    lines = [(i, j, re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" "))
             for i, t in rows if i is not None for j, line in enumerate((t or "").split("\n"))]
    seen, gone = [], {}
    for i, j, line in sorted(lines):
        if len(line) >= least:
            if any(line == s or (min(len(line), len(s)) >= near and abs(len(line) - len(s)) <= k
                                 and edits(line, s) <= k) for s in seen):
                gone.setdefault(i, set()).add(j)
            seen.append(line)
    return gone


def test_dropped_lines_equal_brute_force_in_pairs_and_in_blocks(spark, monkeypatch):
    r = random.Random(4)
    lines = []
    for _ in range(40):
        base = "".join(r.choice("abcdef \t") for _ in range(r.randint(38, 60)))
        lines += [change(r, base, r.randint(0, 4)) for _ in range(5)]
    r.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 5:i * 5 + 5])) for i in range(40)] + [(None, lines[0]), (77, None), (78, "")]
    want = brute(rows)
    assert sum(map(len, want.values())) > 30
    for size in (64, 2):
        monkeypatch.setattr(ld, "BLOCK_LINES", size)
        got = ld.dropped_lines(spark, plain(spark, rows)).collect()
        assert {x.doc_id: set(x.dropped) for x in got} == want


def test_text_keeps_everything_else(spark):
    a, b = "this line is long enough to count once", "another line that is long enough too"
    docs = plain(spark, [(1, f"{a}\r\nx\n\n{a}  \nx"), (2, f"{b}\n{a}\nend"), (3, None), (4, "x")]).withColumn(
        "n_chars", F.lit(-1).cast("long"))
    got = {r.doc_id: (r.text, r.n_chars) for r in ld.dedup_lines(spark, docs).collect()}
    assert got == {1: (f"{a}\r\nx\n\nx", len(a) + 6), 2: (f"{b}\nend", len(b) + 4), 3: (None, -1), 4: ("x", -1)}


def test_odd_rows_empty_table_and_plan(spark):
    docs = odd_documents(spark)
    out = ld.dedup_lines(spark, docs)
    assert out.columns == docs.columns and out.count() == len(ODD)
    assert "Python" not in out._jdf.queryExecution().toString()
    assert ld.dedup_lines(spark, docs.limit(0)).collect() == []
    assert ld.line_counts(spark, docs).count() == len(ODD)


def test_every_line_takes_part_in_the_query_and_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    from polderlake.llm.queries import QUERIES

    r, lines = random.Random(6), ["***", "***", "", "", "}", "}", "ok", "ok", "no", "Contents", "Contents"]
    for _ in range(30):
        base = "".join(r.choice("abcdefghij") for _ in range(r.randint(8, 42)))
        lines += [change(r, base, r.randint(0, 3)) for _ in range(4)]
    r.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 5:i * 5 + 5])) for i in range(-(-len(lines) // 5))]
    allowed = lambda n: 2 if n >= 20 else 1 if n >= 10 else 0
    seen, want = [], []
    for i, text in rows:
        kept = []
        for line in text.split("\n"):
            if not any(c.isalnum() for c in line):
                kept.append(line)
                continue
            if not any(edits(line, s) <= allowed(min(len(line), len(s))) for s in seen):
                kept.append(line)
            seen.append(line)
        want.append("\n".join(kept))
    docs = plain(spark, rows)
    got = corpus_pipeline.dedup_lines(spark, docs, "").orderBy("doc_id").collect()
    assert [x.text for x in got] == want
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    counts = QUERIES["op2_line_dedup"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [x.n_chars_kept for x in counts] == [len(t) for t in want]


def test_near_lines_share_a_key_that_one_of_them_posts(spark):
    r, classes = random.Random(8), [(2, 20, ld.MAX_CHARS), (1, 10, 20)]
    rows = []
    for _ in range(400):
        a = "".join(r.choice("abé😀") for _ in range(r.randint(9, 45)))
        rows.append((a, change(r, a, r.randint(0, 2))))
    found = []
    for side in (0, 1):
        df = spark.createDataFrame([(n, row[side]) for n, row in enumerate(rows)], "n long, line string")
        found.append([x["keys"] for x in df.select("n", ld.segment_keys(classes).alias("keys")).orderBy("n").collect()])
    met = 0
    for (a, b), ka, kb in zip(rows, *found):
        assert len(ka) == (12 if len(a) > 20 else 16 if len(a) == 20 else 4 if len(a) >= 10 else 0)
        allowed = max([k for k, least, most in classes if least <= min(len(a), len(b)) and max(len(a), len(b)) <= most],
                      default=0)
        if a != b and allowed and edits(a, b) <= allowed:
            met += 1
            shared = {k & ~1 for k in ka} & {k & ~1 for k in kb}
            assert any(k & 1 and k & ~1 in shared for k in [*ka, *kb])
    assert met > 150


def test_both_classes_are_read_in_one_pass(spark, monkeypatch):
    seen, scans = ld.segment_keys, []
    monkeypatch.setattr(ld, "segment_keys", lambda classes: scans.append(classes) or seen(classes))
    ld.dropped_lines(spark, plain(spark, [(1, "a line of some length\nanother"), (2, "one more")]), **ld.EVERY_LINE)
    assert len(scans) == 1 and {k for k, _, _ in scans[0]} == {1, 2}


def test_keys_as_rows_are_compiled_and_equal_those_as_an_array(spark):
    r, classes = random.Random(9), [(2, 20, ld.MAX_CHARS), (1, 10, 20)]
    rows = [(n, "".join(r.choice("abé😀") for _ in range(r.randint(5, 45)))) for n in range(200)]
    lines = spark.createDataFrame(rows, "n long, line string")
    keys = ld.segment_keys(classes)
    want = {x.n: sorted(x["keys"]) for x in lines.select("n", keys.alias("keys")).collect()}
    got = {n: [] for n in want}
    found = keys.rows(lines)
    for x in found.collect():
        got[x.n].append(x.key | x.posted)
    assert found.columns == ["n", "line", "key", "posted"] and {n: sorted(k) for n, k in got.items()} == want
    assert "lambda" not in found._jdf.queryExecution().toString()  # Spark interprets functions of elements
