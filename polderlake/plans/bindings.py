"""Every operator bound to the test tables: ``name -> f(spark, sf_dir)``.

The tables stand in for the open data: nation is the region, the order year
the period, order priority the dwelling type, customers the residents, and
events the sensor readings.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from polderlake.catalog import (DEFAULT_EXTENSION, EXTENSIONS, LANDED_FEEDS, STATISTICS, DatasetSpec,
                                bronze_path, gold_path, load_catalog, schema_of,
                                silver_path)
from polderlake.functions import scalars as fn
from polderlake.operators import (dedupe, deltas, digests, incremental, joins, monitor, paging,
                                  quality, regions, rollup)
from polderlake.operators.normalize import (cast_columns, drop_invalid, flatten_envelope,
                                            rename_columns, tag_gold, tag_lineage)
from polderlake.plans import gold as gold_plan
from polderlake.plans.silver import (LANDED_READERS, build_feed_silver, build_silver,
                                     refresh_current)
from polderlake.session import scratch_path, side_by_side
from polderlake.sources import buckets, compaction, history, landing, readers, recut, tables
from polderlake.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RUN_TS = datetime(2024, 2, 1, 6, 0, 0)
ANCHOR = "2024-01-20"
REGION_PERIOD = ["region_code", "period_code"]


def query(f: Query) -> Query:
    QUERIES[f.__name__.removesuffix("_query")] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def year(column: str) -> Column:
    return F.year(column).cast("int")


def stamp() -> Column:
    return F.lit(RUN_TS.isoformat(" ")).cast("timestamp_ntz")


def orders_by_region(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the region of their customer and the period of their date."""
    customers = table(spark, d, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("region_code"),
        "c_acctbal")
    return joins.enrich(
        table(spark, d, "orders"), customers, ["o_custkey"], ["region_code", "c_acctbal"], "inner"
    ).withColumns({"period_code": year("o_orderdate"),
                   "ingestion_date": F.to_date("o_orderdate")})


def with_region_name(df: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """Names go onto aggregated rows, not onto facts."""
    names = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("region_code"), F.col("n_name").alias("region_name"))
    return joins.lookup(df, names, ["region_code"], ["region_name"], "UNKNOWN", side="unique")


# ---- sources and sinks ------------------------------------------------------------------


@query
def scan_parquet(spark, d):
    return readers.read_parquet(spark, f"{d}/customer.parquet").select(
        "c_custkey", "c_nationkey", "c_acctbal")


@query
def read_envelope_json(spark, d):
    df, path = table(spark, d, "customer"), scratch_path(spark, "envelope")
    landing.land_envelopes(df, path, rows_per_file=5_000)
    return readers.read_envelope(spark, path, df.schema)


@query
def read_envelope_lines(spark, d):
    df, path = table(spark, d, "orders"), scratch_path(spark, "envelope-lines")
    landing.land_envelopes(df, path, rows_per_file=1_000, pretty=False)
    return readers.read_envelope(spark, path, df.schema, multi_line=False)


@query
def recut_envelope(spark, d):
    """Large pretty-printed documents, cut into lines by tasks that each see a part, and read back."""
    df, path = table(spark, d, "conversations"), scratch_path(spark, "whole")
    odd = df.withColumn("text", F.concat(F.col("text"), F.lit(' }] \\" {[ "value": [')))
    landing.land_envelopes(odd, path, rows_per_file=20_000)
    recut.recut(spark, path, f"{path}-lines")
    return readers.read_pages(spark, f"{path}-lines", df.schema)


@query
def read_paged_json(spark, d):
    df, path = table(spark, d, "orders"), scratch_path(spark, "pages")
    landing.land_pages(df, path, rows_per_file=10_000)
    return readers.read_pages(spark, path, df.schema)


def _landed_lines(spark: SparkSession, df: DataFrame, broken: list[str], label: str,
                  column: str | None) -> str:
    """Documents one per line with broken ones among them."""
    path = scratch_path(spark, label)
    docs = landing.bundle(df, 1_000)
    rows = F.to_json("rows") if column is None else F.to_json(F.struct(F.col("rows").alias(column)))
    bad = spark.createDataFrame([(b,) for b in broken], "value string")
    docs.select(rows.alias("value")).unionByName(bad).write.text(path)
    return path


def _with_rejects(rows: DataFrame, rejects: DataFrame) -> DataFrame:
    counted = rows.agg(F.count("o_orderkey").alias("n")).select(F.lit("rows").alias("what"), "n")
    return counted.unionByName(
        rejects.groupBy(F.col("reason").alias("what")).agg(F.count("*").alias("n")))


@query
def read_envelope_damaged(spark, d):
    """A cut-off document and an error document between good ones are counted, not lost."""
    df = table(spark, d, "orders")
    path = _landed_lines(spark, df, ['{"value": [{"o_orderkey": 1}, {"o_ord', '{"error": "busy"}'],
                         "damaged-envelopes", "value")
    rows = readers.read_envelope(spark, path, df.schema, multi_line=False, skip_damaged=True)
    return _with_rejects(rows, readers.damaged_documents(spark, path, df.schema, multi_line=False))


@query
def read_pages_damaged(spark, d):
    df = table(spark, d, "orders")
    path = _landed_lines(spark, df, ['[{"o_orderkey": 1}, {"o_orderkey": 2'], "damaged-pages", None)
    rows = readers.read_pages(spark, path, df.schema, skip_damaged=True)
    return _with_rejects(rows, readers.damaged_documents(spark, path, df.schema, None, False))


@query
def read_csv_header(spark, d):
    df, path = table(spark, d, "part"), scratch_path(spark, "csv")
    landing.land_csv(df, path)
    return readers.read_csv(spark, path, df.schema)


@query
def read_commented_csv(spark, d):
    df, path = table(spark, d, "events"), scratch_path(spark, "weather")
    landing.land_commented_csv(df, path)
    return readers.read_commented_csv(spark, path, df.schema)


@query
def read_geojson_features(spark, d):
    df, path = table(spark, d, "supplier"), scratch_path(spark, "geojson")
    landing.land_geojson(df, path, "s_suppkey", "s_suppkey", "s_acctbal")
    features = readers.read_geojson(spark, path, df.schema)
    return features.select(
        "feature_id", "geometry_type", F.element_at("coordinates", 1).alias("x"),
        F.element_at("coordinates", 2).alias("y"), *df.columns)


@query
def read_xml_rows(spark, d):
    df, path = table(spark, d, "supplier"), scratch_path(spark, "xml")
    landing.land_xml(df, path, "measurement", "measurements")
    return readers.read_xml(spark, path, "measurement", df.schema)


@query
def read_json_lines(spark, d):
    df, path = table(spark, d, "conversations"), scratch_path(spark, "traffic")
    df.write.json(path)
    return readers.read_json_files(spark, f"{path}/*.json", df.schema)


@query
def parse_json_payload(spark, d):
    events = table(spark, d, "events").select("event_type", "props")
    return (readers.parse_json(events, "props", "k bigint")
            .groupBy("event_type")
            .agg(F.sum("k").alias("sum_k"), F.count("k").alias("n_k")))


def _orders_by_period(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("period_code", year("o_orderdate"))


@query
def partition_pruned_read(spark, d):
    path = scratch_path(spark, "partitioned")
    tables.load_partitions(_orders_by_period(spark, d), path, "period_code")
    return readers.read_partition(spark, path, 1998, "period_code")


@query
def idempotent_partition_load(spark, d):
    """Loaded as a whole, then one period loaded again: nothing doubles, nothing is lost."""
    path = scratch_path(spark, "reloaded")
    df = _orders_by_period(spark, d)
    tables.load_partitions(df, path, "period_code")
    tables.load_partitions(df.where(F.col("period_code") == 1998), path, "period_code")
    return rollup.rollup(spark.read.parquet(path), ["period_code"], [
        rollup.Measure("n", "count", "o_orderkey"),
        rollup.Measure("total_value", "sum", "o_totalprice")])


@query
def empty_reload(spark, d):
    """A date loaded again without rows is empty afterwards; the others stay."""
    path = scratch_path(spark, "emptied")
    dated = _orders_by_period(spark, d).withColumn(
        "ingestion_date", F.concat(F.col("period_code").cast("string"), F.lit("-01-01")))
    tables.load_partitions(dated, path)
    incremental.reprocess(dated.drop("ingestion_date").limit(0), path, "1998-01-01")
    return readers.read_silver(spark, path).groupBy(
        F.year("ingestion_date").alias("period")).agg(F.count("o_orderkey").alias("n"))


@query
def partition_with_new_column(spark, d):
    """A partition that brings a column of its own is read with it."""
    path = scratch_path(spark, "widened")
    orders = _orders_by_period(spark, d)
    tables.load_partitions(orders.where("period_code = 1998").withColumn(
        "late", F.col("o_orderstatus") != "F"), path, "period_code")
    tables.load_partitions(orders.where("period_code <> 1998"), path, "period_code")
    both = readers.read_silver(spark, path).groupBy("period_code").agg(F.count("late").alias("n_late"))
    one = readers.read_partition(spark, path, 1998, "period_code")
    return both.unionByName(one.groupBy("period_code").agg(F.count("late").alias("n_late")))


def _orders_with_null_keys(spark: SparkSession, d: str) -> DataFrame:
    """Many orders per customer; those in process lose their customer."""
    key = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey").cast("string"))
    return table(spark, d, "orders").select(key.alias("key"), "o_orderkey", "o_totalprice")


@query
def upsert_null_and_repeated_keys(spark, d):
    """The delta holds every key more than once, the null key too: one row of each is left."""
    orders = _orders_with_null_keys(spark, d)
    delta = orders.unionByName(orders.withColumn("o_totalprice", F.col("o_totalprice") + 1))
    return incremental.upsert(orders, delta, ["key"], ["o_totalprice", "o_orderkey"])


@query
def changes_with_null_and_repeated_keys(spark, d):
    orders = _orders_with_null_keys(spark, d)
    price = F.when(F.col("key").cast("long") % 2 == 0, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice"))
    return incremental.detect_changes(orders, orders.withColumn("o_totalprice", price), ["key"],
                                      ["o_totalprice"])


@query
def gold_overwrite_roundtrip(spark, d):
    path = scratch_path(spark, "gold")
    trends = gold_value_trends(spark, d)
    tables.write_gold(trends, path)
    tables.write_gold(trends, path)
    return readers.read_parquet(spark, path)


@query
def append_schema_evolution(spark, d):
    """Two batches with one differing column each, appended and read as one table."""
    path = scratch_path(spark, "evolving")
    first, second = _parties(spark, d)
    tables.append_evolving(first, path)
    tables.append_evolving(second, path)
    return readers.read_silver(spark, path).select(
        "party_key", "party_name", "balance", "segment", "nation_key")


def _widened(spark: SparkSession, d: str) -> str:
    """Orders in three loads: amounts as int, as long, and with cents and a status."""
    path, orders = scratch_path(spark, "widened"), table(spark, d, "orders")
    for i, (key, amount) in enumerate([("int", "int"), ("long", "long"), ("long", "decimal(15,2)")]):
        price = "o_totalprice" if i == 2 else "floor(o_totalprice)"
        load = orders.where(f"o_orderkey % 3 = {i}").select(
            F.col("o_orderkey").cast(key).alias("order_key"), F.expr(price).cast(amount).alias("amount"),
            *(["o_orderstatus"] if i == 2 else []))
        history.append_versioned(load, path, f"load-{i}")
    return path


@query
def widened_loads(spark, d):
    return history.read_versioned(spark, _widened(spark, d)).withColumn("amount", F.col("amount").cast("double"))


@query
def schema_history(spark, d):
    """What each load changed, with the rows visible at its version."""
    path = _widened(spark, d)
    seen = reduce(DataFrame.unionByName, [
        history.read_versioned(spark, path, v).agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("version", F.lit(v)) for v in range(3)])
    return history.schema_history(spark, path).join(seen, "version")


def _parties(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    customers = table(spark, d, "customer").select(
        F.col("c_custkey").alias("party_key"), F.col("c_name").alias("party_name"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("party_key"), F.col("s_name").alias("party_name"),
        F.col("s_acctbal").alias("balance"),
        F.col("s_nationkey").cast("string").alias("nation_key"))
    return customers, suppliers


@query
def assign_pages(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return paging.assign_pages(orders, "o_orderkey", page_size=1000)


@query
def page_manifest(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    return paging.page_manifest(paging.assign_pages(orders, "o_orderkey", 1000), 1000)


@query
def page_gaps(spark, d):
    """Blocks of ten order keys as pages; those with an order of a deep debtor got lost."""
    orders = table(spark, d, "orders").withColumn("page_idx", F.expr("o_orderkey div 10"))
    debtors = table(spark, d, "customer").where("c_acctbal < -500").select(
        F.col("c_custkey").alias("o_custkey"))
    lost = joins.restrict_to(orders, debtors, ["o_custkey"]).select("page_idx")
    pages = joins.orphans(orders, lost, ["page_idx"]).select("page_idx")
    return paging.page_gaps(paging.page_manifest(pages, 10))


def _byte_pages(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return paging.assign_pages_by_bytes(orders, "o_orderkey", page_bytes=20_000)


@query
def assign_pages_by_bytes(spark, d):
    return _byte_pages(spark, d)


@query
def byte_manifest(spark, d):
    return paging.byte_manifest(_byte_pages(spark, d))


def _landed_pages(spark: SparkSession, d: str) -> tuple[DataFrame, str, DataFrame]:
    """Pages landed under their names, some of them lost and some cut: all, where, which to repeat."""
    pages, path = _byte_pages(spark, d), scratch_path(spark, "named-pages")
    landing.land_named_pages(pages.where("page_idx % 7 != 3 AND (page_idx % 5 != 2 OR row_idx % 2 = 0)"), path)
    return pages, path, paging.page_requests(paging.byte_manifest(pages), landing.landed_pages(spark, path))


@query
def landed_page_requests(spark, d):
    return _landed_pages(spark, d)[2]


@query
def landed_pages_repaired(spark, d):
    """The pages of the list landed again; then the rows of all pages."""
    pages, path, requests = _landed_pages(spark, d)
    asked = scratch_path(spark, "requests")
    requests.select("part_name").write.parquet(asked)
    landing.land_named_pages(joins.restrict_to(pages, spark.read.parquet(asked), ["part_name"]), path)
    own = pages.select("o_orderkey", "o_custkey", "o_orderstatus").schema
    return readers.read_pages(spark, path, own).select(*own.fieldNames())


# ---- projections, filters, scalar functions ---------------------------------------------


@query
def flatten_envelope_query(spark, d):
    documents = landing.bundle(table(spark, d, "conversations"), rows_per_file=500)
    return flatten_envelope(documents.select(F.col("rows").alias("value")))


@query
def tag_lineage_query(spark, d):
    return tag_lineage(table(spark, d, "customer"), "cbs", "customers", "2024-02-01", stamp())


@query
def tag_gold_query(spark, d):
    return tag_gold(table(spark, d, "supplier"), "gold_suppliers")


@query
def normalize_columns(spark, d):
    return rename_columns(table(spark, d, "customer"), {
        "c_custkey": "resident_code", "c_name": "resident_name", "c_nationkey": "region_code",
        "c_acctbal": "income_eur"})


@query
def normalize_types(spark, d):
    raw = table(spark, d, "customer").select(
        "c_custkey", F.concat(F.lit("  "), F.split_part("c_name", F.lit("#"), F.lit(2))).alias("code"),
        "c_mktsegment", F.col("c_acctbal").cast("string").alias("income"))
    typed = cast_columns(raw, {"code": "bigint", "c_mktsegment": "int", "income": "double"})
    return typed.select("c_custkey", "code", "income",
                        F.col("c_mktsegment").isNull().alias("segment_rejected"))


@query
def drop_invalid_query(spark, d):
    return drop_invalid(table(spark, d, "customer"), ["c_custkey", "c_name"],
                        {"negative_balance": F.col("c_acctbal") < 0})


@query
def relative_date_window(spark, d):
    anchor = F.lit(ANCHOR).cast("date")
    return (table(spark, d, "events")
            .where(fn.in_relative_window(F.col("ts"), anchor, 7, 1))
            .select("event_id", "event_type", "value", fn.compact_date(F.col("ts")).alias("day")))


@query
def payload_profile(spark, d):
    documents = table(spark, d, "documents").select("doc_id", "text")
    return quality.profile_payload(documents, "text").drop("text")


@query
def payload_profile_pages(spark, d):
    """The same on raw markup, refusing empty payloads."""
    pages = quality.require_payload(table(spark, d, "pages").select("page_id", "html"), "html")
    return quality.profile_payload(pages, "html").drop("html", "is_empty")


@query
def map_label_default(spark, d):
    """Format labels to extensions; the stand-in labels are padded, upper-cased event types."""
    raw = F.concat(F.lit("  "), F.upper("event_type"), F.lit(" "))
    known = {"click": "json", "error": "xml"}
    return table(spark, d, "events").select(
        "event_id", fn.map_label(raw, known, DEFAULT_EXTENSION).alias("event_extension"),
        fn.map_label(F.col("event_type"), EXTENSIONS, DEFAULT_EXTENSION).alias("extension"))


@query
def run_key_format(spark, d):
    ts = F.col("ts")
    key = fn.run_key(ts)
    return table(spark, d, "events").select(
        "event_id", key.alias("run_key"), fn.iso_date(ts).alias("iso_date"),
        fn.compact_date(ts).alias("compact_date"),
        fn.iso_date(fn.parse_run_key(key)).alias("parsed_date"),
        fn.endpoint_file(F.initcap("event_type")).alias("file_name"))


# ---- deduplication, incremental, set operations -----------------------------------------


@query
def dedupe_latest_2key(spark, d):
    return dedupe.dedupe_latest(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"],
                                "l_shipdate")


@query
def dedupe_latest_3key(spark, d):
    orders = _orders_by_period(spark, d)
    return dedupe.dedupe_latest(orders, ["o_custkey", "period_code", "o_orderpriority"],
                                "o_orderdate", ["o_orderkey"])


EVENTS = DatasetSpec(
    source="test", name="events", silver_table="silver_events",
    schema=schema_of(
        event_id="long", ts="timestamp_ntz", user_id="long",
        event_type="string", value="double", props="string"),
    grain=("user_id", "event_type"), measures=("value",))


@query
def latest_with_clashing_names(spark, d):
    """Columns named like the operators' own stay."""
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", F.col("l_quantity").alias("_rank"),
        F.col("l_extendedprice").alias("_row"), F.col("l_tax").alias("_id"))
    latest = dedupe.dedupe_latest(lines, ["l_orderkey", "l_linenumber"], "l_shipdate")
    return paging.assign_pages(latest, ["l_orderkey", "l_linenumber"], page_size=500)


@query
def dedupe_by_grain(spark, d):
    return dedupe.dedupe_by_grain(table(spark, d, "events"), EVENTS, "ts")


@query
def drop_exact_duplicates(spark, d):
    return dedupe.drop_exact_duplicates(
        table(spark, d, "documents"), ["text"], keep_first_by="doc_id")


@query
def drop_exact_duplicate_rows(spark, d):
    return dedupe.drop_exact_duplicates(
        table(spark, d, "documents").select("text", "lang"))


ORDERS = DatasetSpec(
    source="test", name="orders", silver_table="silver_orders",
    schema=schema_of(o_orderkey="long", o_orderstatus="string", o_orderdate="timestamp_ntz",
                     o_totalprice="double"),
    grain=("o_orderkey",), measures=("o_totalprice",))
LOAD_DATES = ("2024-01-01", "2024-01-02", "2024-01-03")


def _order_loads(spark: SparkSession, d: str) -> DataFrame:
    """Three loads of the orders: all, the open ones repriced, one year repriced again."""
    orders = table(spark, d, "orders").select(ORDERS.schema.fieldNames())
    price = F.col("o_totalprice")
    loads = [
        orders,
        orders.where("o_orderstatus = 'O'").withColumn("o_totalprice", price * 2),
        orders.where(F.year("o_orderdate") == 1998).withColumn("o_totalprice", price * 4),
    ]
    return incremental.union_batches(*[
        load.withColumn("ingestion_date", F.lit(date)) for load, date in zip(loads, LOAD_DATES)])


@query
def latest_snapshot(spark, d):
    return dedupe.latest_snapshot(_order_loads(spark, d), ["o_orderkey"])


@query
def incremental_snapshot(spark, d):
    """The same rows, from the snapshot of each date before and the rows of the next."""
    root = scratch_path(spark, "snapshots")
    loads = _order_loads(spark, d).withColumns({
        "ingestion_timestamp": F.lit(RUN_TS), "source": F.lit("test"),
        "dataset_name": F.lit("orders")})
    tables.load_partitions(loads, silver_path(root, ORDERS))
    previous = None
    for date in LOAD_DATES:
        path = refresh_current(spark, ORDERS, root, date, previous)
        previous = date
    return readers.read_silver(spark, path, ORDERS.silver_schema).drop(
        "ingestion_timestamp", "source", "dataset_name")


@query
def union_batches(spark, d):
    return incremental.union_batches(*_parties(spark, d))


NEW_KEY_OFFSET = 1_000_000_000_000


def _base_and_delta(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice",
                                              "o_orderdate", "o_orderstatus")
    repriced = orders.where(F.year("o_orderdate") == 2001).withColumn(
        "o_totalprice", F.col("o_totalprice") * 2)
    unchanged = orders.where((F.year("o_orderdate") == 2000) & (F.col("o_orderstatus") == "F"))
    added = orders.where((F.year("o_orderdate") == 2000) & (F.col("o_orderstatus") == "P")
                         ).withColumn("o_orderkey", F.col("o_orderkey") + NEW_KEY_OFFSET)
    delta = incremental.union_batches(repriced, unchanged, added)
    keep = ["o_orderkey", "o_custkey", "o_totalprice"]
    return orders.select(keep), delta.select(keep)


@query
def incremental_upsert(spark, d):
    base, delta = _base_and_delta(spark, d)
    return incremental.upsert(base, delta, ["o_orderkey"])


@query
def detect_new_and_changed(spark, d):
    base, delta = _base_and_delta(spark, d)
    changes = incremental.detect_changes(base, delta, ["o_orderkey"],
                                         ["o_custkey", "o_totalprice"])
    return changes.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def _events_base_and_delta(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Readings keyed by their timestamp; those of errors come again, some under a new time."""
    events = table(spark, d, "events").select("ts", "event_type", "value")
    late = F.expr("ts + make_dt_interval(0, 0, 0, 0.000001)")
    errors = events.where("event_type = 'error'").withColumn("value", -F.col("value"))
    return events, errors.unionByName(errors.where("value < -100").withColumn("ts", late))


@query
def upsert_by_timestamp(spark, d):
    """Keys that differ by one microsecond are two keys."""
    base, delta = _events_base_and_delta(spark, d)
    return incremental.upsert(base, delta, ["ts", "event_type"], ["value"])


@query
def bucketed_upsert(spark, d):
    """The same upsert into a table of key-hash buckets, of which it rewrites the touched ones."""
    path = scratch_path(spark, "bucketed")
    base, delta = _base_and_delta(spark, d)
    buckets.create_bucketed(base, path, ["o_orderkey"], 16)
    buckets.upsert_bucketed(spark, path, delta, ["o_totalprice"])
    return buckets.read_bucketed(spark, path)


@query
def changes_by_digest(spark, d):
    """Changed keys between two loads of the orders, found from the root of their digest trees."""
    base, delta = _base_and_delta(spark, d)
    load = incremental.upsert(base, delta, ["o_orderkey"]).where("o_custkey % 97 <> 0")
    return digests.changes_by_digest(base, load, ["o_orderkey"], ["o_custkey", "o_totalprice"])


@query
def reconcile_fingerprints(spark, d):
    """Lines against their orders: some lose a line, some gain one, counts per status may agree."""
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey")
    moved = lines.where("l_orderkey % 101 <> 0").unionByName(
        lines.where("l_orderkey % 103 = 0 AND l_returnflag = 'R'"))
    off = digests.unreconciled_keys(lines, moved, ["l_returnflag"], ["l_orderkey"])
    counted = off.groupBy("l_returnflag", "what").agg(F.count(F.lit(1)).alias("n_keys"))
    state = digests.reconcile(lines, moved, ["l_returnflag"], ["l_orderkey"])
    return counted.join(state, "l_returnflag")


GOLD_MEASURES = [
    rollup.Measure("n_orders", "count", "o_orderkey"), rollup.Measure("total", "sum", "o_totalprice"),
    rollup.Measure("avg_price", "avg", "o_totalprice"), rollup.Measure("min_price", "min", "o_totalprice"),
    rollup.Measure("max_price", "max", "o_totalprice"), rollup.Measure("newest", "newest", "o_orderdate")]


@query
def incremental_gold(spark, d):
    """Gold per customer group and status after a change, from its state before and the delta."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate",
                                              "o_orderstatus")
    before = orders.withColumn("region", F.col("o_custkey") % 25)
    keys = ["region", "o_orderstatus"]
    path = scratch_path(spark, "gold-state")
    deltas.gold_state(before, keys, GOLD_MEASURES).write.parquet(path)
    left = before.where("o_orderkey % 50 = 3 OR (region = 7 AND o_orderstatus = 'P')")
    came = before.where("o_orderkey % 50 = 3 AND o_orderkey % 4 = 1").withColumn(
        "o_totalprice", F.col("o_totalprice") / 2)
    after = before.where("NOT (o_orderkey % 50 = 3 OR (region = 7 AND o_orderstatus = 'P'))").unionByName(came)
    state = deltas.apply_delta(spark.read.parquet(path), came, left, after, keys, GOLD_MEASURES)
    return deltas.gold_from_state(state, after, keys, GOLD_MEASURES)


@query
def reprocess_date(spark, d):
    """All dates loaded, one reprocessed with other rows; the others stay."""
    events, path = table(spark, d, "events"), scratch_path(spark, "reprocessed")
    loaded = events.withColumn("ingestion_date", fn.iso_date(F.col("ts")))
    tables.load_partitions(loaded, path)
    replacement = loaded.where("ingestion_date = '2024-01-02' AND event_type <> 'error'")
    incremental.reprocess(replacement.drop("ingestion_date"), path, "2024-01-02")
    return (spark.read.schema(loaded.schema).parquet(path)
            .groupBy("ingestion_date", "event_type").agg(F.count(F.lit(1)).alias("n")))


# ---- joins ------------------------------------------------------------------------------


@query
def dimension_lookup(spark, d):
    nations = table(spark, d, "nation").withColumnsRenamed(
        {"n_nationkey": "c_nationkey", "n_regionkey": "r_regionkey"})
    placed = joins.lookup(table(spark, d, "customer"), nations, ["c_nationkey"],
                          ["n_name", "r_regionkey"], {"n_name": "UNKNOWN"})
    named = joins.lookup(placed, table(spark, d, "region"), ["r_regionkey"], ["r_name"], "UNKNOWN")
    return named.select("c_custkey", "c_name", "n_name", "r_name")


@query
def lookup_with_default(spark, d):
    return joins.lookup(table(spark, d, "documents").select("doc_id", "lang"),
                        table(spark, d, "labels"), ["doc_id"], ["quality", "toxic"], -1)


@query
def salted_enrich(spark, d):
    """The join for a large right side, hot keys salted, here on every order line."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber",
                                               "l_extendedprice")
    suppliers = table(spark, d, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    return joins.enrich(lines, suppliers, ["l_suppkey"], ["s_name", "s_nationkey"],
                        side="salted")


@query
def restrict_to_known_keys(spark, d):
    documents = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return joins.restrict_to(documents, table(spark, d, "labels"), ["doc_id"])


@query
def dq_referential(spark, d):
    documents = table(spark, d, "documents").select("doc_id")
    return joins.orphans(documents, table(spark, d, "labels"), ["doc_id"])


@query
def dq_referential_report(spark, d):
    return quality.referential_report(table(spark, d, "documents"), table(spark, d, "labels"),
                                      "documents", ["doc_id"])


@query
def assign_region_grid(spark, d):
    points = table(spark, d, "embeddings").select(
        "vec_id", F.element_at("embedding", 1).cast("double").alias("x"),
        F.element_at("embedding", 2).cast("double").alias("y"))
    return regions.assign_region(points, _boxes(spark), "x", "y", cell=0.25).select(
        "vec_id", "region_id")


@query
def assign_region_levels(spark, d):
    """Small boxes inside one that is a thousand cells wide: no box is listed in many cells."""
    points = table(spark, d, "embeddings").select(
        "vec_id", F.element_at("embedding", 1).cast("double").alias("x"),
        F.element_at("embedding", 2).cast("double").alias("y"))
    wide = spark.range(1).select(F.lit("wide").alias("region_id"), *[
        F.lit(v).alias(c) for c, v in (("x_min", -62.5), ("x_max", 62.5), ("y_min", -62.5), ("y_max", 0.0))])
    return regions.assign_region(points, _boxes(spark).unionByName(wide), "x", "y", cell=0.125).select(
        "vec_id", "region_id")


# A star with four points, and the square hole in its middle, around a place.
STAR = ((4, 0), (1, 1), (0, 4), (-1, 1), (-4, 0), (-1, -1), (0, -4), (1, -1))
HOLE = ((0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5), (0.5, -0.5))


@query
def assign_polygon_regions(spark, d):
    """One concave polygon with a hole per nation, larger ones for later regions, overlapping."""
    east, north = (F.col("n_nationkey") % 5 - 2) * 0.125, (F.floor(F.col("n_nationkey") / 5) - 2) * 0.125
    scale = F.pow(F.lit(2.0), F.col("n_regionkey") - 6)
    ring = lambda corners: F.array(*[
        F.array(east + scale * a, north + scale * b) for a, b in corners])
    polygons = table(spark, d, "nation").select(
        F.col("n_name").alias("region_id"), F.array(ring(STAR), ring(HOLE)).alias("rings"))
    points = table(spark, d, "embeddings").select(
        "vec_id", F.element_at("embedding", 1).cast("double").alias("x"),
        F.element_at("embedding", 2).cast("double").alias("y"))
    return regions.assign_polygon(points, polygons, "x", "y", cell=0.125).select("vec_id", "region_id")


def _boxes(spark: SparkSession) -> DataFrame:
    """4 x 4 boxes over [-0.25, 0.25) squared, so that some points lie in none."""
    side, low = 0.125, -0.25
    x, y = F.floor(F.col("id") / 4), F.col("id") % 4
    return spark.range(16).select(
        F.format_string("box-%02d", "id").alias("region_id"),
        (x * side + low).alias("x_min"), ((x + 1) * side + low).alias("x_max"),
        (y * side + low).alias("y_min"), ((y + 1) * side + low).alias("y_max"))


# ---- gold tables ------------------------------------------------------------------------


@query
def gold_region_period_stats(spark, d):
    stats = rollup.region_period_stats(orders_by_region(spark, d), REGION_PERIOD,
                                       population="o_totalprice", households="o_custkey",
                                       income="c_acctbal")
    return tag_gold(with_region_name(stats, spark, d), "gold_region_period_stats")


@query
def gold_value_trends(spark, d):
    trends = rollup.value_trends(orders_by_region(spark, d), REGION_PERIOD, "o_totalprice")
    return tag_gold(with_region_name(trends, spark, d), "gold_value_trends")


@query
def gold_market_analysis(spark, d):
    """Dwellings are the line quantities of an order; the value is the mean order price."""
    orders = orders_by_region(spark, d).withColumnRenamed("o_orderpriority", "dwelling_type")
    lines = table(spark, d, "lineitem")
    quantities = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        fn.exact_sum(lines, "l_quantity").alias("quantity"))
    facts = joins.enrich(orders, quantities, ["o_orderkey"], ["quantity"], side="unique")
    market = rollup.market_from_facts(facts, REGION_PERIOD, ["dwelling_type"], "quantity",
                                      "o_totalprice")
    return tag_gold(with_region_name(market, spark, d), "gold_market_analysis")


def _shipped_value(spark: SparkSession, d: str) -> DataFrame:
    """Mean line price per supplier region and shipping year."""
    suppliers = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("region_code"))
    lines = table(spark, d, "lineitem").select(
        "l_suppkey", "l_extendedprice", year("l_shipdate").alias("period_code"))
    return rollup.rollup_through(
        lines, suppliers, ["l_suppkey"], ["region_code"], ["period_code"],
        [rollup.Measure("shipped_value", "avg", "l_extendedprice")])


@query
def gold_socio_indicators(spark, d):
    """Ordered and shipped years differ at both ends, so the inner join drops some of each."""
    socio = rollup.socio_indicators(
        orders_by_region(spark, d), _shipped_value(spark, d), REGION_PERIOD, REGION_PERIOD,
        avg_income="o_totalprice", median_income="c_acctbal", per_resident="shipped_value")
    return tag_gold(with_region_name(socio, spark, d), "gold_socio_indicators")


@query
def gold_regional_dashboard(spark, d):
    orders = orders_by_region(spark, d)
    settled = F.when(F.col("o_orderstatus") == "F", F.col("c_acctbal"))
    base = rollup.rollup(orders.withColumn("settled", settled), REGION_PERIOD, [
        rollup.Measure("population", "count", "o_orderkey"),
        rollup.Measure("households", "max", "o_custkey"),
        rollup.Measure("income", "avg", "settled")])
    wide = joins.wide_join(base, [(_shipped_value(spark, d), ["shipped_value"])], REGION_PERIOD)
    return tag_gold(with_region_name(wide, spark, d), "gold_regional_dashboard")


@query
def rollup_by_spec(spark, d):
    spec = DatasetSpec(source="test", name="readings", silver_table="silver_readings",
                       schema=EVENTS.schema, grain=("event_type",), measures=("value",))
    return rollup.rollup_by_spec(table(spark, d, "events"), spec)


@query
def sums_of_fine_and_large_values(spark, d):
    """Decimals beyond the second count, and a large value does not fail a sum."""
    lines = table(spark, d, "lineitem").withColumns({
        "fine": F.col("l_extendedprice") * F.col("l_discount") / 3, "large": F.lit(2.0 ** 57)})
    return rollup.rollup(lines, ["l_returnflag", "l_linestatus"], [
        rollup.Measure("sum_fine", "sum", "fine"), rollup.Measure("avg_fine", "avg", "fine"),
        rollup.Measure("sum_large", "sum", "large")])


@query
def sums_of_any_size(spark, d):
    """Totals far beyond 1e20, values near 1e-20, and cents beside billions."""
    lines = table(spark, d, "lineitem").withColumns({
        "huge": F.col("l_quantity") * 1e20, "tiny": F.col("l_quantity") / 1e20,
        "mixed": F.when(F.col("l_linenumber") == 1, F.col("l_quantity") * 1e12).otherwise(
            F.col("l_extendedprice"))})
    return rollup.rollup(lines, ["l_returnflag", "l_linestatus"], [
        rollup.Measure(f"sum_{c}", "sum", c) for c in ("huge", "tiny", "mixed")])


@query
def regional_feature_mart(spark, d):
    """Geography, housing, mobility and climate per region, each reduced before the join."""
    regions = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("region_code"), F.col("n_name").alias("region_name"))
    geography = rollup.rollup(
        table(spark, d, "supplier").withColumnRenamed("s_nationkey", "region_code"),
        ["region_code"], [rollup.Measure("n_sites", "count", "s_suppkey"),
                          rollup.Measure("site_value", "avg", "s_acctbal")])
    customers = table(spark, d, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("region_code"))
    housing = rollup.rollup_through(
        table(spark, d, "orders"), customers, ["o_custkey"], ["region_code"], [], [
            rollup.Measure("n_sales", "count", "o_orderkey"),
            rollup.Measure("sale_value", "avg", "o_totalprice")])
    readings = rollup.region_features(
        table(spark, d, "events"), _user_regions(spark, d), ["user_id"], "region_code", [], "value"
    ).withColumnsRenamed({"n": "n_readings", "avg_v": "avg_reading"})
    mart = joins.wide_join(regions, [(geography, ["n_sites", "site_value"]),
                                     (housing, ["n_sales", "sale_value"]),
                                     (readings, ["n_readings", "avg_reading"])], ["region_code"])
    return mart.fillna(0, ["n_sites", "n_sales", "n_readings"])


def _user_regions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("region_code"))


@query
def climate_features_by_region(spark, d):
    events = table(spark, d, "events").withColumn("day", fn.iso_date(F.col("ts")))
    return rollup.region_features(events, _user_regions(spark, d), ["user_id"], "region_code",
                                  ["day"], "value")


@query
def minute_facts(spark, d):
    return rollup.minute_facts(table(spark, d, "events"), "ts", ["event_type"], "value")


@query
def hourly_facts_from_minute(spark, d):
    return rollup.coarser_facts(minute_facts(spark, d), ["event_type"])


# ---- quality and monitoring -------------------------------------------------------------

CUSTOMER_CONTRACT = schema_of(
    c_custkey="long", c_name="string", c_nationkey="integer",
    c_acctbal="double", c_mktsegment="integer", c_comment="string")


@query
def dq_schema(spark, d):
    """Customers as raw text against a contract with one wrong type and one missing column."""
    raw = table(spark, d, "customer").withColumn("c_custkey", F.col("c_custkey").cast("string"))
    return quality.schema_report(raw, "customer", CUSTOMER_CONTRACT).unionByName(
        quality.type_report(raw, "customer", CUSTOMER_CONTRACT))


@query
def dq_nulls(spark, d):
    labelled = joins.lookup(table(spark, d, "documents").select("doc_id", "lang", "n_chars"),
                            table(spark, d, "labels"), ["doc_id"], ["quality", "toxic"])
    return quality.null_report(labelled, "documents", labelled.columns)


@query
def dq_ranges(spark, d):
    return quality.range_report(table(spark, d, "lineitem"), "lineitem", [
        quality.RangeRule("l_quantity", 1, 45), quality.RangeRule("l_discount", 0, 0.05),
        quality.RangeRule("l_extendedprice", low=0)])


@query
def dq_grain_unique(spark, d):
    return quality.duplicate_grains(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def dq_grain_report(spark, d):
    lines = quality.grain_report(table(spark, d, "lineitem"), "lineitem",
                                 ["l_orderkey", "l_linenumber"])
    orders = quality.grain_report(table(spark, d, "orders"), "orders", ["o_orderkey"])
    return lines.unionByName(orders)


def _customer_rules() -> dict[str, Column]:
    return {"negative_balance": F.col("c_acctbal") < 0,
            "low_balance": F.col("c_acctbal") < 500,
            "no_segment": F.col("c_mktsegment").isNull()}


@query
def dq_quarantine(spark, d):
    good, bad = quality.quarantine(table(spark, d, "customer"), _customer_rules())
    columns = ["c_custkey", "c_acctbal"]
    return good.select(*columns, F.lit("good").alias("status"), F.lit("").alias("reasons")).union(
        bad.select(*columns, F.lit("bad"), F.array_join("reasons", ",")))


@query
def dq_quarantine_table(spark, d):
    """Both sides written in one pass, then counted from the written table."""
    path = scratch_path(spark, "quarantine")
    quality.write_quarantine(table(spark, d, "customer"), _customer_rules(), path)
    return spark.read.parquet(path).groupBy("dq_status").agg(F.count(F.lit(1)).alias("n"))


def _datasets(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    names = ["customer", "supplier", "orders", "lineitem", "events", "documents"]
    found = {name: table(spark, d, name) for name in names}
    found["events_none"] = found["events"].where("event_type = 'none'")
    return found


@query
def availability(spark, d):
    checks = [quality.availability(df, name) for name, df in _datasets(spark, d).items()]
    return reduce(DataFrame.unionByName, checks)


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Run records of a load of every dataset, two endpoints each, one of them failed.

    Each load ran before and failed; the record of that run is still there.
    """
    records = []
    for name, df in _datasets(spark, d).items():
        counted = df.agg(F.count(F.lit(1)).alias("n_records"))
        for endpoint, share in (("TypedDataSet", 1), ("DataProperties", 0)):
            failed = name == "documents" and share == 0
            records.append(counted.select(
                F.lit("test").alias("source"), F.lit(name).alias("dataset_name"),
                F.lit("2024-02-01").alias("ingestion_date"), F.lit(endpoint).alias("endpoint"),
                F.lit("2024-02-01_06-00-00").alias("ingestion_datetime"),
                (F.col("n_records") * share).alias("n_records"),
                F.lit("failed" if failed else "success").alias("status")))
    runs = reduce(DataFrame.unionByName, records)
    return runs.unionByName(runs.withColumns({
        "ingestion_datetime": F.lit("2024-02-01_05-00-00"), "status": F.lit("failed")}))


@query
def run_summary(spark, d):
    return quality.run_summary(_runs(spark, d))


@query
def run_gate(spark, d):
    return quality.run_gate(quality.run_summary(_runs(spark, d)))


@query
def run_manifest(spark, d):
    """Counts observed while writing, appended to the runs table and read back."""
    runs, records = scratch_path(spark, "runs"), []
    for name, df in _datasets(spark, d).items():
        counted, seen = tables.observed(df, f"run_{name}")
        tables.write_gold(counted, scratch_path(spark, f"manifest-{name}"))
        records.append(tables.run_record(spark, "test", name, "2024-02-01", "silver",
                                         seen.get["n_records"], RUN_TS))
    tables.write_run(incremental.union_batches(*records), runs)
    return readers.read_silver(spark, runs, tables.RUN_SCHEMA).select(
        "dataset_name", "ingestion_datetime", "endpoint", "n_records", "status")


def _small_files(spark: SparkSession, d: str) -> tuple[str, StructType]:
    """Events by month in many small files, those of the first months compacted, the rest loose."""
    path, events = scratch_path(spark, "small-files"), table(spark, d, "events")
    months = events.withColumn("batch_id", F.month("ts")).repartition(6, "event_id")
    months.write.partitionBy("batch_id").parquet(path)
    compaction.compact_batches(spark, path, months.schema, last_batch=4)
    events.withColumn("batch_id", F.lit(99)).where("value > 50").write.mode("append").partitionBy(
        "batch_id").parquet(path)  # a writer goes on beside the compaction
    compaction.compact_batches(spark, path, months.schema, last_batch=8)
    compaction.expire(spark, path)
    return path, months.schema


@query
def compacted_batches(spark, d):
    return compaction.read_packed(spark, *_small_files(spark, d)).select(
        "event_id", "user_id", "event_type", "value", "batch_id")


@query
def freshness(spark, d):
    anchor = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return monitor.freshness(table(spark, d, "events"), ["event_type"], "ts", anchor, 1)


@query
def latency(spark, d):
    """Days from the order to its shipment, by order year."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"),
                                              "o_orderdate")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate")
    dated = joins.enrich(lines, orders, ["l_orderkey"], ["o_orderdate"], "inner")
    return monitor.latency(dated.withColumn("period_code", year("o_orderdate")), ["period_code"],
                           F.col("o_orderdate"), F.col("l_shipdate"))


@query
def latency_distribution(spark, d):
    """Sketches of each order month, kept apart and merged by order year."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber")
    dated = joins.enrich(lines, orders, ["l_orderkey"], ["o_orderdate"], "inner")
    arrived = F.expr("l_shipdate + make_dt_interval(0, l_orderkey % 24, l_linenumber, 0)")
    months = monitor.latency_sketch(
        dated.withColumns({"period_code": year("o_orderdate"), "month": F.month("o_orderdate")}),
        ["period_code", "month"], F.col("o_orderdate"), arrived)
    path = scratch_path(spark, "latency-sketches")
    months.write.partitionBy("month").parquet(path)
    merged = monitor.merge_sketches([spark.read.parquet(path)], ["period_code"])
    return monitor.sketch_quantiles(merged, ["period_code"], [0.5, 0.95, 0.99])


@query
def lineage_reachable(spark, d):
    """Regions lead to nations, nations to customers and suppliers, suppliers to the parts they ship."""
    node = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    edge = lambda df, a, b: df.select(node(*a).alias("from_table"), node(*b).alias("to_table"))
    edges = reduce(DataFrame.unionByName, [
        edge(table(spark, d, "nation"), ("region", "n_regionkey"), ("nation", "n_nationkey")),
        edge(table(spark, d, "customer"), ("nation", "c_nationkey"), ("customer", "c_custkey")),
        edge(table(spark, d, "supplier"), ("nation", "s_nationkey"), ("supplier", "s_suppkey")),
        edge(table(spark, d, "lineitem"), ("supplier", "l_suppkey"), ("flag", "l_returnflag"))])
    return monitor.reachable(edges)


@query
def failure_rate(spark, d):
    return monitor.failure_rate(table(spark, d, "events"), fn.iso_date(F.col("ts")),
                                F.col("event_type") == "error")


def _layers(spark: SparkSession, d: str) -> DataFrame:
    """Counts of lines, of lines one per grain (as many as distinct grains), of gold groups."""
    lines = table(spark, d, "lineitem")
    silver = lines.select("l_orderkey", "l_linenumber").distinct()
    gold = lines.select("l_suppkey", year("l_shipdate").alias("period_code")).distinct()
    return monitor.layer_counts("lineitem", [("bronze", lines), ("silver", silver), ("gold", gold)])


@query
def layer_reconcile(spark, d):
    return monitor.layer_reconcile(_layers(spark, d))


@query
def lineage_edges(spark, d):
    names = spark.createDataFrame(
        [("lineitem", "bronze", "bronze_lineitem"), ("lineitem", "silver", "silver_lineitem"),
         ("lineitem", "gold", "gold_supplier_year")],
        "dataset string, layer string, table_name string")
    return monitor.lineage_edges(monitor.layer_reconcile(_layers(spark, d)), names)


# ---- streaming --------------------------------------------------------------------------


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    # Brackets make the name a pattern: the source then takes one file as well as a folder.
    path = f"{d}/events.parque[t]"
    return streams.open_stream(spark, "parquet", EVENTS.schema, path=path)


def _timed(df: DataFrame) -> DataFrame:
    """Watermarks need an instant, so the zone-less time is read in the session's zone."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def _zoneless(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp_ntz"))


def _clean_event(df: DataFrame) -> DataFrame:
    parsed = readers.parse_json(df, "props", "k bigint").drop("props")
    valid = drop_invalid(parsed, ["event_id", "ts"], {"failed": F.col("event_type") == "error"})
    return tag_lineage(valid, "ndw", "events", "2024-02-01", stamp())


@query
def stream_to_silver(spark, d):
    out = scratch_path(spark, "stream-silver")
    streams.stream_to_silver(_event_stream(spark, d), _clean_event, f"{out}/silver",
                             f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/silver")


@query
def stream_layers(spark, d):
    """Raw and cleaned rows landed by one stream, counted per layer and type."""
    out = scratch_path(spark, "stream-layers")
    streams.stream_layers(_event_stream(spark, d), _clean_event, f"{out}/bronze", f"{out}/silver",
                          f"{out}/checkpoint").awaitTermination()
    counted = [
        streams.read_batches(spark, f"{out}/{layer}").groupBy("event_type").agg(
            F.count(F.lit(1)).alias("n")).withColumn("layer", F.lit(layer))
        for layer in ("bronze", "silver")]
    return counted[0].unionByName(counted[1])


@query
def stream_minute_facts(spark, d):
    out = scratch_path(spark, "stream-minutes")
    streams.stream_minute_facts(_timed(_event_stream(spark, d)), "ts", ["event_type"], "value",
                                "31 days", f"{out}/facts", f"{out}/checkpoint").awaitTermination()
    facts = streams.read_updates(spark, f"{out}/facts", ["minute", "event_type"])
    return _zoneless(facts, "minute")


@query
def stream_minute_facts_compacted(spark, d):
    """The same sink read from a snapshot of its first batch and the batches after it."""
    out = scratch_path(spark, "stream-compacted")
    streams.stream_minute_facts(_timed(_event_stream(spark, d)), "ts", ["event_type"], "value",
                                "31 days", f"{out}/facts", f"{out}/checkpoint").awaitTermination()
    keys = ["minute", "event_type"]
    streams.write_update_snapshot(spark, f"{out}/facts", keys, f"{out}/snapshot", 0)
    return _zoneless(streams.read_updates(spark, f"{out}/facts", keys, f"{out}/snapshot", 0), "minute")


@query
def stream_dedupe(spark, d):
    """Every event delivered twice, by two sources, kept once."""
    out = scratch_path(spark, "stream-dedupe")
    twice = _timed(_event_stream(spark, d)).union(_timed(_event_stream(spark, d)))
    streams.stream_dedupe(twice, ["event_id"], "ts", "31 days", f"{out}/rows",
                          f"{out}/checkpoint").awaitTermination()
    return _zoneless(spark.read.parquet(f"{out}/rows"), "ts")


@query
def stream_upsert_latest(spark, d):
    out = scratch_path(spark, "stream-upsert")
    streams.stream_upsert_latest(_event_stream(spark, d), ["user_id", "event_type"], ["ts"],
                                 f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return streams.read_latest(spark, f"{out}/rows", ["user_id", "event_type"], ["ts"])


# ---- whole pipeline ---------------------------------------------------------------------


def _land_statistics(spark: SparkSession, d: str, bronze: str, ingestion_date: str) -> None:
    """The four statistics datasets, one row per customer and order year, as envelopes."""
    orders = orders_by_region(spark, d)
    keys = ["o_custkey", "period_code"]
    by_type = gold_plan.staged(spark, orders.groupBy(*keys, "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("worth"),
        F.min("o_totalprice").alias("low"), F.max("c_acctbal").alias("income")), "facts-by-type")
    facts = gold_plan.staged(spark, by_type.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.max("o_custkey").alias("households"), F.max("worth").alias("worth"),
        F.min("low").alias("low"), F.max("income").alias("income")), "facts")
    region = F.concat(F.lit("BU"), F.col("o_custkey").cast("string"))
    named = {
        "RegioS": region, "RegioNaam": F.concat(F.lit("Buurt "), F.col("o_custkey").cast("string")),
        "SoortRegio_2": F.lit("Buurt"),
        "Perioden": F.concat(F.col("period_code").cast("string"), F.lit("JJ00")),
        "Inwoners_5": F.col("n"), "AantalHuishoudens_10": F.col("households"),
        "GemiddeldInkomenPerInwoner_25": F.col("income"), "GemiddeldeWOZWaarde_1": F.col("worth"),
        "AantalWoningen_1": F.col("n"), "GemiddeldInkomenHuishouden_6": F.col("worth"),
        "MediaanInkomenHuishouden_7": F.col("low"), "TypeWoning_3": F.col("o_orderpriority")}

    def land(spec: DatasetSpec) -> None:
        rows = by_type if "dwelling_type" in spec.grain else facts
        rows = rows.select(*[named[c].alias(c) for c in spec.schema.fieldNames()])
        path = f"{bronze_path(bronze, spec)}/ingestion_date={ingestion_date}/typeddataset.json"
        landing.land_envelopes(rows, path, compression="lz4")

    side_by_side(spark, [partial(land, spec) for spec in STATISTICS])


@query
def landed_feeds(spark, d):
    """GeoJSON, commented CSV and XML from bronze to silver; values come back from each."""
    root = scratch_path(spark, "landed-feeds")
    pand, _, weather, traffic = LANDED_FEEDS
    folder = lambda spec: f"{bronze_path(root, spec)}/ingestion_date=2024-02-01"
    suppliers = table(spark, d, "supplier")
    landing.land_geojson(suppliers, f"{folder(pand)}/data.json", "s_suppkey", "s_suppkey", "s_acctbal")
    landing.land_xml(suppliers, f"{folder(traffic)}/raw_data.xml", "measurement", "measurements")
    landing.land_commented_csv(table(spark, d, "events").select("event_id", "user_id", "value"),
                               f"{folder(weather)}/raw_data.csv")
    for spec in (pand, weather, traffic):
        build_feed_silver(spark, spec, LANDED_READERS[spec.name], root, f"{root}/silver", "2024-02-01",
                          RUN_TS)
    silver = lambda spec, key: readers.read_silver(spark, silver_path(f"{root}/silver", spec)).agg(
        F.count("*").alias("n"), F.sum(F.expr(key).cast("long")).alias("keys")).select(
        F.lit(spec.name).alias("feed"), "n", "keys")
    return silver(pand, "properties['s_suppkey']").unionByName(silver(weather, "event_id")).unionByName(
        silver(traffic, "s_suppkey"))


def _medallion(spark: SparkSession, d: str) -> str:
    """Bronze to silver to gold for the catalogue; the housing stock is loaded twice."""
    root = scratch_path(spark, "medallion")
    runs = f"{root}/runs"
    _land_statistics(spark, d, f"{root}/bronze", "2024-02-01")
    load = lambda spec: build_silver(
        spark, spec, f"{root}/bronze", f"{root}/silver", "2024-02-01", RUN_TS, runs)
    side_by_side(spark, [partial(load, spec) for spec in load_catalog(STATISTICS).values()])
    load(STATISTICS[2])
    gold_plan.build_gold(spark, f"{root}/silver", f"{root}/gold", RUN_TS)
    return f"{root}/gold"


@query
def medallion_market(spark, d):
    return readers.read_parquet(spark, gold_path(_medallion(spark, d), "cbs", gold_plan.MARKET))


@query
def medallion_tables(spark, d):
    """Rows and regions of all five gold tables."""
    root = _medallion(spark, d)
    groups = {gold_plan.NEIGHBOURHOOD: "cbs", gold_plan.TRENDS: "cbs", gold_plan.MARKET: "cbs",
              gold_plan.SOCIO: "cbs", gold_plan.DASHBOARD: "consolidated"}
    return reduce(DataFrame.unionByName, [
        readers.read_parquet(spark, gold_path(root, group, name)).groupBy("gold_table").agg(
            F.count("*").alias("n"), F.count_distinct("RegioS").alias("n_regions"))
        for name, group in groups.items()])
