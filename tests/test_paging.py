from conftest import collect
from pyspark.sql import functions as F

from polderlake.operators import paging
from polderlake.session import LISTING
from polderlake.sources import landing, readers


def test_pages_are_full_but_for_the_last(spark):
    df = spark.range(0, 1_050, 1, 7).select((1_050 - F.col("id")).alias("id"))
    pages = paging.assign_pages(df, "id", page_size=100, partitions=5)
    rows = sorted((r.id, r.row_idx, r.page_idx, r.skip, r.part_name) for r in pages.collect())
    assert [r[1] for r in rows] == list(range(1_050))
    assert all(r[2] == r[1] // 100 and r[3] == r[2] * 100 for r in rows)
    assert rows[-1][4] == "part-00010.json"
    manifest = sorted(paging.page_manifest(pages, 100).collect())
    assert [m[3] for m in manifest] == [100] * 10 + [50] and [m[4] for m in manifest] == [False] * 10 + [True]


def test_exactly_full_last_page_still_ends_the_table(spark):
    manifest = collect(paging.page_manifest(paging.assign_pages(spark.range(200), "id", 100), 100))
    assert [(m[3], m[4]) for m in manifest] == [(100, False), (100, True)]


def test_one_key_and_copies_spread_over_ranges(spark):
    """Two thirds of the rows share a key and are copies of each other."""
    df = spark.range(0, 9_000, 1, 24).select(
        F.when(F.col("id") % 3 < 2, F.lit(5)).otherwise(F.col("id")).alias("k"))
    pages = paging.assign_pages(df, "k", page_size=100, partitions=8)
    assert pages.select("row_idx").distinct().count() == 9_000
    assert pages.agg(F.max("row_idx")).first()[0] == 8_999
    ordered = [r.k for r in pages.orderBy("row_idx").collect()]
    assert ordered == sorted(ordered)
    ranges = pages.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in ranges) < 9_000 / 3


def test_gaps(spark):
    manifest = spark.createDataFrame([(1, 10), (2, 10), (4, 10), (5, 3)], "page_idx bigint, n bigint")
    assert collect(paging.page_gaps(manifest)) == [(0, 0, 1), (3, 3, 1)]
    wide = spark.createDataFrame([(0, 1), (5_000_000, 1)], "page_idx bigint, n bigint")
    assert collect(paging.page_gaps(wide)) == [(1, 4_999_999, 4_999_999)]
    whole = spark.createDataFrame([(0, 10), (1, 2)], "page_idx bigint, n bigint")
    assert collect(paging.page_gaps(whole)) == []


def test_a_short_page_in_the_middle_shows(spark):
    pages = spark.createDataFrame([(0,)] * 3 + [(1,)] * 2 + [(2,)] * 3, "page_idx bigint")
    assert [m[4] for m in collect(paging.page_manifest(pages, 3))] == [False, True, True]


def byte_pages(rows, budget):
    """Page of each row by running sums, a row above the budget counting as one budget."""
    at, pages = 0, []
    for size in rows:
        pages.append(at // budget)
        at += min(size, budget)
    return pages


def test_byte_pages_equal_running_sums(spark):
    """Rows of every size, some far above the budget, over several ranges."""
    df = spark.range(0, 3_000, 1, 7).select(
        F.col("id").alias("k"), F.when(F.col("id") % 11 > 0, F.repeat(F.lit("é"), (F.col("id") % 97).cast("int")))
        .alias("text"), F.when(F.col("id") % 500 == 3, F.repeat(F.lit("x"), F.lit(5_000))).alias("big"))
    pages = paging.assign_pages_by_bytes(df, "k", 1_000, partitions=5)
    rows = sorted(pages.collect(), key=lambda r: r.k)
    assert [r.row_idx for r in rows] == list(range(3_000))
    assert [r.page_idx for r in rows] == byte_pages([r.row_bytes for r in rows], 1_000)
    manifest = sorted(paging.byte_manifest(pages).collect())
    assert [m.page_idx for m in manifest] == list(range(len(manifest)))  # no number left out
    assert sum(m.n for m in manifest) == 3_000 and [m.is_last for m in manifest].index(True) == len(manifest) - 1
    last = {r.page_idx: r.row_bytes for r in rows}
    assert all(m.n_bytes - 1 - last[m.page_idx] < 1_000 for m in manifest)


def test_landed_pages_are_held_against_the_manifest(spark, tmp_path):
    path = str(tmp_path / "pages")
    df = spark.range(0, 400, 1, 3).select(F.col("id").alias("k"), F.lit('a"\n,é').alias("text"),
                                          F.when(F.col("id") % 2 == 0, F.col("id")).alias("half"))
    pages = paging.assign_pages_by_bytes(df, "k", 600, partitions=3)
    manifest = paging.byte_manifest(pages)
    landing.land_named_pages(pages, path)
    look = lambda: {r.part_name: r.reason for r in paging.page_requests(
        manifest, landing.landed_pages(spark, path)).collect()}
    assert look() == {}
    folder = lambda i: tmp_path / "pages" / f"part_name=part-{i:05d}.json"
    file = lambda i: next(f for f in folder(i).iterdir() if f.name.startswith("part-"))
    for hidden in (tmp_path / "pages").rglob(".*.crc"):
        hidden.unlink()
    whole = {i: file(i).read_text() for i in range(8)}
    file(0).write_text(whole[0][:-20])
    file(1).write_text("")
    file(2).write_text(whole[2].replace("}]", '},{"k":1}]'))
    file(3).write_text("[]")
    file(4).write_text(whole[4].replace("é", "e", 1))
    (folder(5) / "part-again.txt").write_text(whole[5])
    (tmp_path / "pages" / "part_name=part-99999.json").mkdir()
    (tmp_path / "pages" / "part_name=part-99999.json" / "part-0.txt").write_text("[]")
    name = "part-{:05d}.json".format
    assert look() == {name(0): "damaged", name(1): "missing", name(2): "long", name(3): "short", name(4): "altered",
                      name(5): "repeated", name(99999): "unknown"}
    untouched = file(6).stat().st_mtime_ns
    landing.land_named_pages(pages.where("page_idx < 6"), path)
    assert look() == {name(99999): "unknown"} and file(6).stat().st_mtime_ns == untouched
    back = readers.read_pages(spark, path, df.schema).select(*df.columns)
    assert collect(back) == collect(df)


def test_page_folders_are_listed_by_few_tasks(spark, tmp_path):
    path, sc = str(tmp_path / "pages"), spark.sparkContext
    pages = paging.assign_pages_by_bytes(spark.range(0, 300, 1, 2), "id", 20, partitions=2)
    landing.land_named_pages(pages, path)
    assert paging.byte_manifest(pages).count() > 100
    before = spark.conf.get(LISTING)

    def tasks_to_open(group, read):
        sc.setJobGroup(group, "")
        read()
        jobs = sc.statusTracker().getJobIdsForGroup(group)
        sc.setLocalProperty("spark.jobGroup.id", None)
        stages = [s for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds]
        return sum(sc.statusTracker().getStageInfo(s).numTasks for s in stages)

    assert 0 < tasks_to_open("landed", lambda: landing.landed_pages(spark, path)) <= max(32, 4 * sc.defaultParallelism)
    assert 0 < tasks_to_open("read", lambda: readers.read_pages(spark, path, "id long")) <= max(32, 4 * sc.defaultParallelism)
    assert spark.conf.get(LISTING) == before


def test_byte_pages_of_odd_tables(spark):
    odd = spark.createDataFrame([(None, "x", 1), (None, "x", 1), (2, None, 5), (2, None, 5)],
                                "_range int, _start string, page_idx int")
    pages = paging.assign_pages_by_bytes(odd, ["page_idx", "_range"], 1)
    rows = sorted(pages.collect(), key=lambda r: r.row_idx)
    assert [(r._range, r._start, r.page_idx, r.row_idx) for r in rows] == [
        (None, "x", 0, 0), (None, "x", 1, 1), (2, None, 2, 2), (2, None, 3, 3)]
    assert paging.assign_pages_by_bytes(odd.limit(0), "_range", 10).collect() == []
    assert paging.byte_manifest(paging.assign_pages_by_bytes(odd.limit(0), "_range", 10)).collect() == []
