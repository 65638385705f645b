"""SQL for DuckDB that states, per query, what the result must be."""

from __future__ import annotations

import re

# Orders with the region of their customer, shared by the gold statements.
ORC = """orc AS (
  SELECT o.*, c_nationkey AS region_code, c_acctbal, CAST(year(o_orderdate) AS INT) AS period_code,
         strftime(o_orderdate, '%Y-%m-%d') AS ingestion_date
  FROM orders o JOIN customer ON o_custkey = c_custkey)"""

SHIPPED = """shipped AS (
  SELECT s_nationkey AS region_code, CAST(year(l_shipdate) AS INT) AS period_code,
         EXACT_SUM(l_extendedprice) / COUNT(l_extendedprice) AS shipped_value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""

TRENDS = f"""WITH {ORC}
SELECT g.*, n_name AS region_name, 'gold_value_trends' AS gold_table FROM (
  SELECT region_code, period_code,
         EXACT_SUM(o_totalprice) / COUNT(o_totalprice) AS avg_property_value,
         MAX(o_totalprice) AS max_property_value, MIN(o_totalprice) AS min_property_value,
         MAX(ingestion_date) AS last_updated
  FROM orc GROUP BY 1, 2) g JOIN nation ON region_code = n_nationkey"""

PARTIES = """SELECT c_custkey AS party_key, c_name AS party_name, c_acctbal AS balance,
       c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS nation_key FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, CAST(s_nationkey AS VARCHAR) FROM supplier"""

DELTA = """delta AS (
  SELECT o_orderkey, o_custkey, o_totalprice * 2 AS o_totalprice FROM orders
  WHERE year(o_orderdate) = 2001
  UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM orders
  WHERE year(o_orderdate) = 2000 AND o_orderstatus = 'F'
  UNION ALL SELECT o_orderkey + 1000000000000, o_custkey, o_totalprice FROM orders
  WHERE year(o_orderdate) = 2000 AND o_orderstatus = 'P')"""

SNAPSHOT = """SELECT o_orderkey, o_orderstatus, o_orderdate,
  CASE WHEN year(o_orderdate) = 1998 THEN o_totalprice * 4
       WHEN o_orderstatus = 'O' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
  CASE WHEN year(o_orderdate) = 1998 THEN '2024-01-03'
       WHEN o_orderstatus = 'O' THEN '2024-01-02' ELSE '2024-01-01' END AS ingestion_date
FROM orders"""

PAGED = """p AS (SELECT o_orderkey, o_custkey,
  CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS row_idx FROM orders)"""

BYTE_PAGED = """sized AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(1 + strlen('{"o_orderkey":' ||
    o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS BIGINT) AS row_bytes
  FROM orders),
p AS (SELECT *, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS row_idx,
    CAST(coalesce(sum(row_bytes) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         // 20000 AS BIGINT) AS page_idx FROM sized),
m AS (SELECT page_idx, printf('part-%05d.json', page_idx) AS part_name, MIN(row_idx) AS skip, COUNT(*) AS n,
    CAST(SUM(row_bytes) + 1 AS BIGINT) AS n_bytes,
    page_idx = (SELECT MAX(page_idx) FROM p) AS is_last FROM p GROUP BY page_idx)"""

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
NON_BLANK = (r"[^\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
             r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def _data_lines(column: str) -> str:
    return (f"CAST(len(list_filter(string_split_regex({column}, '{LINE_BREAK}'), "
            f"lambda x: regexp_matches(x, '{NON_BLANK}') AND NOT starts_with(x, '#'))) AS BIGINT)")


MINUTES = """SELECT date_trunc('minute', ts) AS minute, event_type, COUNT(*) AS n,
  COUNT(value) AS n_values, EXACT_SUM(value) AS total,
  EXACT_SUM(value) / COUNT(value) AS avg_value
FROM events GROUP BY 1, 2"""

LATEST_EVENT = """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id, event_type
  ORDER BY ts DESC NULLS LAST, event_id DESC, value DESC, props DESC) AS rn FROM events) WHERE rn = 1"""

RUNS = """runs AS (
  SELECT d AS dataset_name, e AS endpoint, CASE WHEN e = 'TypedDataSet' THEN n ELSE 0 END AS n_records,
         CASE WHEN d = 'documents' AND e = 'DataProperties' THEN 'failed' ELSE 'success' END AS status
  FROM (SELECT 'customer' AS d, COUNT(*) AS n FROM customer
        UNION ALL SELECT 'supplier', COUNT(*) FROM supplier
        UNION ALL SELECT 'orders', COUNT(*) FROM orders
        UNION ALL SELECT 'lineitem', COUNT(*) FROM lineitem
        UNION ALL SELECT 'events', COUNT(*) FROM events
        UNION ALL SELECT 'documents', COUNT(*) FROM documents
        UNION ALL SELECT 'events_none', COUNT(*) FROM events WHERE event_type = 'none') counted,
       (VALUES ('TypedDataSet'), ('DataProperties')) endpoints(e)),
summary AS (
  SELECT 'test' AS source, dataset_name, '2024-02-01' AS ingestion_date,
         COUNT(endpoint) AS n_endpoints, CAST(SUM(n_records) AS BIGINT) AS total_records,
         COALESCE(MAX(status) FILTER (status <> 'success'), 'success') AS status
  FROM runs GROUP BY dataset_name)"""

LAYERS = """layers AS (
  SELECT (SELECT COUNT(*) FROM lineitem) AS bronze,
         (SELECT COUNT(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS silver,
         (SELECT COUNT(*) FROM (SELECT DISTINCT l_suppkey, year(l_shipdate) FROM lineitem)) AS gold)"""

CLEAN_EVENT = """SELECT event_id, ts, user_id, event_type, value,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  TIMESTAMP '2024-02-01 06:00:00' AS ingestion_timestamp, 'ndw' AS source,
  'events' AS dataset_name, '2024-02-01' AS ingestion_date
FROM events WHERE event_type <> 'error'"""

ORACLES: dict[str, str] = {
    # sources and sinks
    "scan_parquet": "SELECT c_custkey, c_nationkey, c_acctbal FROM customer",
    "read_envelope_json": "SELECT * FROM customer",
    "read_envelope_lines": "SELECT * FROM orders",
    "read_paged_json": "SELECT * FROM orders",
    "read_csv_header": "SELECT * FROM part",
    "read_commented_csv": "SELECT * FROM events",
    "read_geojson_features": """SELECT CAST(s_suppkey AS VARCHAR) AS feature_id,
  'Point' AS geometry_type, CAST(s_suppkey AS DOUBLE) AS x, s_acctbal AS y, * FROM supplier""",
    "read_xml_rows": "SELECT * FROM supplier",
    "read_json_lines": "SELECT * FROM conversations",
    "parse_json_payload": """SELECT event_type,
  CAST(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k,
  COUNT(json_extract_string(props, '$.k')) AS n_k FROM events GROUP BY 1""",
    "partition_pruned_read": """SELECT *, CAST(year(o_orderdate) AS INT) AS period_code
FROM orders WHERE year(o_orderdate) = 1998""",
    "idempotent_partition_load": """SELECT CAST(year(o_orderdate) AS INT) AS period_code,
  COUNT(o_orderkey) AS n, EXACT_SUM(o_totalprice) AS total_value
FROM orders GROUP BY 1""",
    "gold_overwrite_roundtrip": TRENDS,
    "append_schema_evolution": PARTIES,
    "widened_loads": """SELECT o_orderkey AS order_key,
  CAST(CASE WHEN o_orderkey % 3 = 2 THEN o_totalprice ELSE floor(o_totalprice) END AS DOUBLE) AS amount,
  CASE WHEN o_orderkey % 3 = 2 THEN o_orderstatus END AS o_orderstatus FROM orders""",
    "schema_history": """SELECT version, column_name, type, change,
  (SELECT COUNT(*) FROM orders WHERE o_orderkey % 3 <= version) AS n_rows
FROM (VALUES (0, 'order_key', 'int', 'added'), (0, 'amount', 'int', 'added'), (1, 'order_key', 'bigint', 'widened'),
  (1, 'amount', 'bigint', 'widened'), (2, 'amount', 'decimal(21,2)', 'widened'),
  (2, 'o_orderstatus', 'string', 'added')) t(version, column_name, type, change)""",
    "assign_pages_by_bytes": f"""WITH {BYTE_PAGED}
SELECT *, printf('part-%05d.json', page_idx) AS part_name FROM p""",
    "byte_manifest": f"WITH {BYTE_PAGED} SELECT * FROM m",
    "landed_page_requests": f"""WITH {BYTE_PAGED},
l AS (SELECT page_idx, COUNT(*) AS n_landed FROM p
  WHERE page_idx % 7 <> 3 AND (page_idx % 5 <> 2 OR row_idx % 2 = 0) GROUP BY 1)
SELECT part_name, page_idx, skip, n, coalesce(n_landed, 0) AS n_landed,
  CASE WHEN n_landed IS NULL THEN 'missing' ELSE 'short' END AS reason
FROM m LEFT JOIN l USING (page_idx) WHERE n_landed IS NULL OR n_landed < n""",
    "compacted_batches": """SELECT event_id, user_id, event_type, value, CAST(month(ts) AS INT) AS batch_id FROM events
UNION ALL SELECT event_id, user_id, event_type, value, 99 FROM events WHERE value > 50""",
    "landed_pages_repaired": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
    "assign_pages": f"""WITH {PAGED}
SELECT *, row_idx // 1000 AS page_idx, row_idx // 1000 * 1000 AS skip,
       printf('part-%05d.json', row_idx // 1000) AS part_name FROM p""",
    "page_manifest": f"""WITH {PAGED},
c AS (SELECT row_idx // 1000 AS page_idx, COUNT(*) AS n FROM p GROUP BY 1)
SELECT page_idx, printf('part-%05d.json', page_idx) AS part_name, page_idx * 1000 AS skip, n,
       n < 1000 OR page_idx = (SELECT MAX(page_idx) FROM c) AS is_last FROM c""",
    "read_envelope_damaged": """SELECT 'rows' AS what, COUNT(*) AS n FROM orders
UNION ALL SELECT 'not JSON', 1 UNION ALL SELECT 'no value', 1""",
    "read_pages_damaged": "SELECT 'rows' AS what, COUNT(*) AS n FROM orders UNION ALL SELECT 'not JSON', 1",
    "empty_reload": """SELECT CAST(year(o_orderdate) AS INT) AS period, COUNT(*) AS n FROM orders
WHERE year(o_orderdate) <> 1998 GROUP BY 1""",
    "partition_with_new_column": """SELECT CAST(year(o_orderdate) AS INT) AS period_code,
  COUNT(*) FILTER (WHERE year(o_orderdate) = 1998) AS n_late FROM orders GROUP BY 1
UNION ALL SELECT 1998, COUNT(*) FROM orders WHERE year(o_orderdate) = 1998""",
    "upsert_null_and_repeated_keys": """WITH k AS (
  SELECT CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS VARCHAR) END AS key, o_orderkey, o_totalprice FROM orders),
u AS (SELECT * FROM k UNION ALL SELECT key, o_orderkey, o_totalprice + 1 FROM k)
SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (
  PARTITION BY key ORDER BY o_totalprice DESC, o_orderkey DESC) AS r FROM u) WHERE r = 1""",
    "changes_with_null_and_repeated_keys": """WITH k AS (
  SELECT CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS VARCHAR) END AS key, MAX(o_totalprice) AS top
  FROM orders GROUP BY 1)
SELECT key, CASE WHEN CAST(key AS BIGINT) % 2 = 0 AND top <> 0 THEN 'changed' ELSE 'same' END AS change FROM k""",
    "page_gaps": """WITH lost AS (SELECT o_orderkey // 10 AS page FROM orders
  JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < -500),
p AS (SELECT DISTINCT o_orderkey // 10 AS page FROM orders
      WHERE o_orderkey // 10 NOT IN (SELECT page FROM lost)),
g AS (SELECT page, COALESCE(LAG(page) OVER (ORDER BY page), -1) AS before FROM p)
SELECT before + 1 AS page_idx, page - 1 AS last_page, page - before - 1 AS n_missing
FROM g WHERE page - before > 1""",
    # projections, filters, scalar functions
    "flatten_envelope": "SELECT * FROM conversations",
    "tag_lineage": """SELECT *, TIMESTAMP '2024-02-01 06:00:00' AS ingestion_timestamp,
  'cbs' AS source, 'customers' AS dataset_name, '2024-02-01' AS ingestion_date FROM customer""",
    "tag_gold": "SELECT *, 'gold_suppliers' AS gold_table FROM supplier",
    "normalize_columns": """SELECT c_custkey AS resident_code, c_name AS resident_name,
  c_nationkey AS region_code, c_acctbal AS income_eur, c_mktsegment FROM customer""",
    "normalize_types": """SELECT c_custkey, TRY_CAST(trim(split_part(c_name, '#', 2)) AS BIGINT) AS code,
  c_acctbal AS income, TRY_CAST(c_mktsegment AS INT) IS NULL AS segment_rejected FROM customer""",
    "drop_invalid": "SELECT * FROM customer WHERE NOT c_acctbal < 0",
    "relative_date_window": """SELECT event_id, event_type, value, strftime(ts, '%Y%m%d') AS day
FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-20' - 7 AND DATE '2024-01-20' - 1""",
    "payload_profile": f"""SELECT doc_id, {_data_lines('text')} AS data_lines,
  CAST(octet_length(encode(text)) AS BIGINT) AS raw_bytes,
  text IS NULL OR NOT regexp_matches(text, '{NON_BLANK}') AS is_empty FROM documents""",
    "payload_profile_pages": f"""SELECT page_id, {_data_lines('html')} AS data_lines,
  CAST(octet_length(encode(html)) AS BIGINT) AS raw_bytes FROM pages""",
    "map_label_default": """SELECT event_id,
  CASE event_type WHEN 'click' THEN 'json' WHEN 'error' THEN 'xml' ELSE 'csv' END AS event_extension,
  'csv' AS extension FROM events""",
    "run_key_format": """SELECT event_id, strftime(ts, '%Y-%m-%d_%H-%M-%S') AS run_key,
  strftime(ts, '%Y-%m-%d') AS iso_date, strftime(ts, '%Y%m%d') AS compact_date,
  strftime(ts, '%Y-%m-%d') AS parsed_date, lower(event_type) || '.json' AS file_name FROM events""",
    # deduplication, incremental, set operations
    "dedupe_latest_2key": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
  PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate DESC NULLS LAST, l_partkey DESC, l_suppkey DESC, l_quantity DESC,
           l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC,
           l_linestatus DESC) AS rn FROM lineitem) WHERE rn = 1""",
    "dedupe_latest_3key": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
  PARTITION BY o_custkey, period_code, o_orderpriority
  ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS rn
  FROM (SELECT *, CAST(year(o_orderdate) AS INT) AS period_code FROM orders)) WHERE rn = 1""",
    "dedupe_by_grain": LATEST_EVENT,
    "drop_exact_duplicates": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
  PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
    "drop_exact_duplicate_rows": "SELECT DISTINCT text, lang FROM documents",
    "latest_snapshot": SNAPSHOT,
    "incremental_snapshot": SNAPSHOT,
    "union_batches": PARTIES,
    "incremental_upsert": f"""WITH {DELTA} SELECT * FROM delta UNION ALL
SELECT o_orderkey, o_custkey, o_totalprice FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM delta d WHERE d.o_orderkey = o.o_orderkey)""",
    "detect_new_and_changed": f"""WITH {DELTA}
SELECT CASE WHEN o.o_orderkey IS NULL THEN 'new' WHEN d.o_orderkey IS NULL THEN 'missing'
            WHEN d.o_totalprice = o.o_totalprice AND d.o_custkey = o.o_custkey THEN 'same'
            ELSE 'changed' END AS change, COUNT(*) AS n
FROM orders o FULL OUTER JOIN delta d ON d.o_orderkey = o.o_orderkey GROUP BY 1""",
    "reprocess_date": """SELECT strftime(ts, '%Y-%m-%d') AS ingestion_date, event_type, COUNT(*) AS n
FROM events
WHERE NOT (CAST(ts AS DATE) = DATE '2024-01-02' AND event_type = 'error') GROUP BY 1, 2""",
    # joins
    "dimension_lookup": """SELECT c_custkey, c_name, COALESCE(n_name, 'UNKNOWN') AS n_name,
  COALESCE(r_name, 'UNKNOWN') AS r_name
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey""",
    "lookup_with_default": """SELECT d.doc_id, lang, COALESCE(quality, -1) AS quality,
  COALESCE(toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "salted_enrich": """SELECT l_orderkey, l_suppkey, l_linenumber, l_extendedprice, s_name,
  s_nationkey FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey""",
    "restrict_to_known_keys": """SELECT doc_id, lang, n_chars FROM documents
WHERE doc_id IN (SELECT doc_id FROM labels)""",
    "dq_referential": """SELECT doc_id FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
    "dq_referential_report": """SELECT 'referential' AS "check", 'documents' AS dataset,
  'doc_id' AS "column", COUNT(*) AS n_bad, COUNT(*) = 0 AS passed FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
    "recut_envelope": """SELECT * REPLACE (text || ' }] \\" {[ "value": [' AS text) FROM conversations""",
    "assign_polygon_regions": """WITH corner AS (
  SELECT * FROM (VALUES (0, 0, 4.0, 0.0), (0, 1, 1, 1), (0, 2, 0, 4), (0, 3, -1, 1), (0, 4, -4, 0),
    (0, 5, -1, -1), (0, 6, 0, -4), (0, 7, 1, -1), (1, 0, 0.5, 0.5), (1, 1, -0.5, 0.5),
    (1, 2, -0.5, -0.5), (1, 3, 0.5, -0.5)) t(ring, i, a, b)),
place AS (
  SELECT n_name, (n_nationkey % 5 - 2) * 0.125::DOUBLE AS east,
         (n_nationkey // 5 - 2) * 0.125::DOUBLE AS north, 2.0::DOUBLE ** (n_regionkey - 6) AS scale
  FROM nation),
vertex AS (
  SELECT n_name, ring, i, east + scale * a::DOUBLE AS x, north + scale * b::DOUBLE AS y,
         count(*) OVER (PARTITION BY n_name, ring) AS k
  FROM place, corner),
edge AS (
  SELECT p.n_name, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2
  FROM vertex p JOIN vertex q ON p.n_name = q.n_name AND p.ring = q.ring AND q.i = (p.i + 1) % p.k),
points AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
hit AS (
  SELECT vec_id, n_name FROM points JOIN edge
    ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
  GROUP BY vec_id, n_name HAVING count(*) % 2 = 1)
SELECT vec_id, n_name AS region_id FROM points LEFT JOIN hit USING (vec_id)""",
    "latest_with_clashing_names": """SELECT *, (row_idx // 500) AS page_idx, (row_idx // 500) * 500 AS skip,
       printf('part-%05d.json', row_idx // 500) AS part_name
FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS row_idx FROM (
  SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity AS _rank, l_extendedprice AS _row, l_tax AS _id
  FROM lineitem QUALIFY row_number() OVER (
    PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate DESC, l_quantity DESC, l_extendedprice DESC, l_tax DESC) = 1))""",
    "upsert_by_timestamp": """WITH e AS (SELECT ts, event_type, value FROM events),
x AS (SELECT ts, event_type, -value AS value FROM e WHERE event_type = 'error'),
delta AS (
  SELECT * FROM (SELECT * FROM x UNION ALL
    SELECT ts + INTERVAL 1 MICROSECOND, event_type, value FROM x WHERE value < -100)
  QUALIFY row_number() OVER (PARTITION BY ts, event_type ORDER BY value DESC) = 1)
SELECT * FROM delta UNION ALL
SELECT * FROM e WHERE NOT EXISTS (
  SELECT 1 FROM delta d WHERE d.ts = e.ts AND d.event_type = e.event_type)""",
    "bucketed_upsert": """WITH delta AS (
  SELECT o_orderkey, o_custkey, o_totalprice * 2 AS o_totalprice FROM orders
  WHERE year(o_orderdate) = 2001 UNION ALL
  SELECT o_orderkey, o_custkey, o_totalprice FROM orders
  WHERE year(o_orderdate) = 2000 AND o_orderstatus = 'F' UNION ALL
  SELECT o_orderkey + 1000000000000, o_custkey, o_totalprice FROM orders
  WHERE year(o_orderdate) = 2000 AND o_orderstatus = 'P')
SELECT * FROM delta UNION ALL
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM delta)""",
    "changes_by_digest": """WITH delta AS (
  SELECT o_orderkey, o_custkey, o_totalprice * 2 AS o_totalprice FROM orders
  WHERE year(o_orderdate) = 2001 UNION ALL
  SELECT o_orderkey, o_custkey, o_totalprice FROM orders
  WHERE year(o_orderdate) = 2000 AND o_orderstatus = 'F' UNION ALL
  SELECT o_orderkey + 1000000000000, o_custkey, o_totalprice FROM orders
  WHERE year(o_orderdate) = 2000 AND o_orderstatus = 'P'),
load AS (
  SELECT * FROM (SELECT * FROM delta UNION ALL
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE o_orderkey NOT IN (SELECT o_orderkey FROM delta))
  WHERE o_custkey % 97 <> 0)
SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey,
       CASE WHEN o.o_orderkey IS NULL THEN 'new' WHEN n.o_orderkey IS NULL THEN 'missing'
            ELSE 'changed' END AS change
FROM orders o FULL JOIN load n ON o.o_orderkey = n.o_orderkey
WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL
   OR (o.o_custkey, o.o_totalprice) IS DISTINCT FROM (n.o_custkey, n.o_totalprice)""",
    "reconcile_fingerprints": """WITH moved AS (
  SELECT l_returnflag, l_orderkey FROM lineitem WHERE l_orderkey % 101 <> 0 UNION ALL
  SELECT l_returnflag, l_orderkey FROM lineitem WHERE l_orderkey % 103 = 0 AND l_returnflag = 'R'),
a AS (SELECT l_returnflag, l_orderkey, count(*) AS x FROM lineitem GROUP BY ALL),
b AS (SELECT l_returnflag, l_orderkey, count(*) AS y FROM moved GROUP BY ALL),
c AS (SELECT l_returnflag, l_orderkey, coalesce(x, 0) AS x, coalesce(y, 0) AS y
      FROM a FULL JOIN b USING (l_returnflag, l_orderkey)),
s AS (SELECT l_returnflag, sum(x)::BIGINT AS rows_before, sum(y)::BIGINT AS rows_after,
             bool_and(x = y) AS same_keys FROM c GROUP BY ALL)
SELECT l_returnflag, CASE WHEN y = 0 THEN 'vanished' WHEN x = 0 THEN 'appeared'
         WHEN y > x THEN 'multiplied' ELSE 'reduced' END AS what, count(*) AS n_keys,
       any_value(rows_before) AS rows_before, any_value(rows_after) AS rows_after,
       any_value(same_keys) AS same_keys
FROM c JOIN s USING (l_returnflag) WHERE x <> y GROUP BY 1, 2""",
    "incremental_gold": """WITH o AS (
  SELECT o_orderkey, o_custkey % 25 AS region, o_orderstatus, o_totalprice, o_orderdate FROM orders),
rest AS (
  SELECT * FROM o WHERE NOT (o_orderkey % 50 = 3 OR (region = 7 AND o_orderstatus = 'P')) UNION ALL
  SELECT o_orderkey, region, o_orderstatus, o_totalprice / 2, o_orderdate FROM o
  WHERE o_orderkey % 50 = 3 AND o_orderkey % 4 = 1)
SELECT region, o_orderstatus, count(o_orderkey) AS n_orders, EXACT_SUM(o_totalprice) AS total,
       EXACT_SUM(o_totalprice) / COUNT(o_totalprice) AS avg_price, min(o_totalprice) AS min_price,
       max(o_totalprice) AS max_price, strftime(max(o_orderdate), '%Y-%m-%d') AS newest
FROM rest GROUP BY region, o_orderstatus""",
    "sums_of_any_size": """SELECT l_returnflag, l_linestatus,
  CAST(CAST(SUM(CAST(l_quantity AS HUGEINT)) * 100000000000000000000::HUGEINT AS VARCHAR) AS DOUBLE) AS sum_huge,
  CAST(SUM(CAST(l_quantity AS HUGEINT)) AS DOUBLE) / 1e20 AS sum_tiny,
  CAST(CAST(SUM(CASE WHEN l_linenumber = 1 THEN CAST(l_quantity AS DECIMAL(38,2)) * 1000000000000
       ELSE CAST(CAST(l_extendedprice AS VARCHAR) AS DECIMAL(38,2)) END) AS VARCHAR) AS DOUBLE) AS sum_mixed
FROM lineitem GROUP BY 1, 2""",
    "assign_region_levels": """WITH boxes AS (
  SELECT printf('box-%02d', i) AS region_id, (i // 4) * 0.125::DOUBLE - 0.25::DOUBLE AS x0,
         (i // 4) * 0.125::DOUBLE - 0.125::DOUBLE AS x1,
         (i % 4) * 0.125::DOUBLE - 0.25::DOUBLE AS y0, (i % 4) * 0.125::DOUBLE - 0.125::DOUBLE AS y1
  FROM range(16) t(i) UNION ALL SELECT 'wide', -62.5, 62.5, -62.5, 0),
points AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
SELECT vec_id, region_id FROM points LEFT JOIN boxes ON x >= x0 AND x < x1 AND y >= y0 AND y < y1""",
    "assign_region_grid": """WITH boxes AS (
  SELECT printf('box-%02d', i) AS region_id, (i // 4) * 0.125::DOUBLE - 0.25::DOUBLE AS x0,
         (i % 4) * 0.125::DOUBLE - 0.25::DOUBLE AS y0 FROM range(16) t(i)),
points AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
SELECT vec_id, region_id FROM points LEFT JOIN boxes
  ON x >= x0 AND x < x0 + 0.125::DOUBLE AND y >= y0 AND y < y0 + 0.125::DOUBLE""",
    # gold tables
    "gold_region_period_stats": f"""WITH {ORC}
SELECT g.*, n_name AS region_name, 'gold_region_period_stats' AS gold_table FROM (
  SELECT region_code, period_code,
         EXACT_SUM(o_totalprice) / COUNT(o_totalprice) AS avg_population,
         MAX(o_totalprice) AS max_population,
         EXACT_SUM(o_custkey) / COUNT(o_custkey) AS avg_households,
         EXACT_SUM(c_acctbal) / COUNT(c_acctbal) AS avg_income_per_resident,
         MAX(ingestion_date) AS last_updated
  FROM orc GROUP BY 1, 2) g JOIN nation ON region_code = n_nationkey""",
    "gold_value_trends": TRENDS,
    "gold_market_analysis": f"""WITH {ORC},
h AS (SELECT orc.*, q FROM orc JOIN (SELECT l_orderkey, EXACT_SUM(l_quantity) AS q
        FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey),
w AS (SELECT region_code, period_code,
             EXACT_SUM(o_totalprice) / COUNT(o_totalprice) AS avg_v
      FROM orc GROUP BY 1, 2)
SELECT h.region_code, n_name AS region_name, h.period_code, o_orderpriority AS dwelling_type,
       CAST(SUM(q) AS DOUBLE) / COUNT(q) AS avg_dwellings, CAST(SUM(q) AS DOUBLE) AS total_dwellings,
       MAX(avg_v) AS avg_property_value, MAX(ingestion_date) AS last_updated,
       'gold_market_analysis' AS gold_table
FROM h LEFT JOIN w ON h.region_code = w.region_code AND h.period_code = w.period_code
JOIN nation ON h.region_code = n_nationkey GROUP BY 1, 2, 3, 4""",
    "gold_socio_indicators": f"""WITH {ORC}, {SHIPPED}
SELECT g.region_code, n_name AS region_name, g.period_code, avg_household_income,
       avg_median_income, shipped_value AS avg_income_per_resident, last_updated,
       'gold_socio_indicators' AS gold_table
FROM (SELECT region_code, period_code,
        EXACT_SUM(o_totalprice) / COUNT(o_totalprice) AS avg_household_income,
        EXACT_SUM(c_acctbal) / COUNT(c_acctbal) AS avg_median_income,
        MAX(ingestion_date) AS last_updated FROM orc GROUP BY 1, 2) g
JOIN shipped s ON g.region_code = s.region_code AND g.period_code = s.period_code
JOIN nation ON g.region_code = n_nationkey""",
    "gold_regional_dashboard": f"""WITH {ORC}, {SHIPPED},
base AS (SELECT region_code, period_code, COUNT(*) AS population, MAX(o_custkey) AS households
         FROM orc GROUP BY 1, 2),
inc AS (SELECT region_code, period_code,
               EXACT_SUM(c_acctbal) / COUNT(c_acctbal) AS income
        FROM orc WHERE o_orderstatus = 'F' GROUP BY 1, 2)
SELECT b.region_code, n_name AS region_name, b.period_code, population, households, shipped_value,
       income, 'gold_regional_dashboard' AS gold_table
FROM base b LEFT JOIN shipped s ON b.region_code = s.region_code AND b.period_code = s.period_code
LEFT JOIN inc i ON b.region_code = i.region_code AND b.period_code = i.period_code
JOIN nation ON b.region_code = n_nationkey""",
    "rollup_by_spec": """SELECT event_type,
  EXACT_SUM(value) / COUNT(value) AS avg_value, MIN(value) AS min_value,
  MAX(value) AS max_value, EXACT_SUM(value) AS sum_value
FROM events GROUP BY 1""",
    "regional_feature_mart": f"""WITH {ORC},
geo AS (SELECT s_nationkey AS k, COUNT(*) AS n_sites,
        EXACT_SUM(s_acctbal) / COUNT(s_acctbal) AS site_value
        FROM supplier GROUP BY 1),
sales AS (SELECT region_code AS k, COUNT(*) AS n_sales,
        EXACT_SUM(o_totalprice) / COUNT(o_totalprice) AS sale_value
        FROM orc GROUP BY 1),
readings AS (SELECT c_nationkey AS k, COUNT(*) AS n_readings,
        EXACT_SUM(value) / COUNT(value) AS avg_reading
        FROM events JOIN customer ON user_id = c_custkey GROUP BY 1)
SELECT n_nationkey AS region_code, n_name AS region_name, COALESCE(n_sites, 0) AS n_sites, site_value,
       COALESCE(n_sales, 0) AS n_sales, sale_value, COALESCE(n_readings, 0) AS n_readings, avg_reading
FROM nation LEFT JOIN geo ON geo.k = n_nationkey LEFT JOIN sales ON sales.k = n_nationkey
LEFT JOIN readings ON readings.k = n_nationkey""",
    "climate_features_by_region": """SELECT c_nationkey AS region_code,
  strftime(ts, '%Y-%m-%d') AS day, COUNT(*) AS n, MIN(value) AS min_v, MAX(value) AS max_v,
  EXACT_SUM(value) / COUNT(value) AS avg_v
FROM events JOIN customer ON user_id = c_custkey GROUP BY 1, 2""",
    "minute_facts": MINUTES,
    "hourly_facts_from_minute": MINUTES.replace("'minute'", "'hour'").replace("AS minute", "AS hour"),
    # quality and monitoring
    "dq_schema": """SELECT * FROM (VALUES
  ('wrong_type', 'customer', 'c_custkey', 1::BIGINT, false),
  ('schema', 'customer', 'c_name', 0, true), ('schema', 'customer', 'c_nationkey', 0, true),
  ('schema', 'customer', 'c_acctbal', 0, true), ('wrong_type', 'customer', 'c_mktsegment', 1, false),
  ('missing_column', 'customer', 'c_comment', 1, false)) t("check", dataset, "column", n_bad, passed)
UNION ALL SELECT 'type', 'customer', "column", n_bad, n_bad = 0 FROM (
  SELECT 'c_custkey' AS "column", 0 AS n_bad UNION ALL SELECT 'c_name', 0
  UNION ALL SELECT 'c_nationkey', 0 UNION ALL SELECT 'c_acctbal', 0
  UNION ALL SELECT 'c_mktsegment', COUNT(*) FROM customer
    WHERE c_mktsegment IS NOT NULL AND TRY_CAST(c_mktsegment AS INT) IS NULL)""",
    "dq_nulls": """SELECT 'nulls' AS "check", 'documents' AS dataset, "column", n_bad, n_bad = 0 AS passed
FROM (WITH j AS (SELECT d.doc_id, lang, n_chars, quality, toxic
                 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
  SELECT 'doc_id' AS "column", COUNT(*) FILTER (doc_id IS NULL) AS n_bad FROM j
  UNION ALL SELECT 'lang', COUNT(*) FILTER (lang IS NULL) FROM j
  UNION ALL SELECT 'n_chars', COUNT(*) FILTER (n_chars IS NULL) FROM j
  UNION ALL SELECT 'quality', COUNT(*) FILTER (quality IS NULL) FROM j
  UNION ALL SELECT 'toxic', COUNT(*) FILTER (toxic IS NULL) FROM j)""",
    "dq_ranges": """SELECT 'range' AS "check", 'lineitem' AS dataset, "column", n_bad, n_bad = 0 AS passed
FROM (SELECT 'l_quantity' AS "column", COUNT(*) FILTER (l_quantity < 1 OR l_quantity > 45) AS n_bad
      FROM lineitem
  UNION ALL SELECT 'l_discount', COUNT(*) FILTER (l_discount < 0 OR l_discount > 0.05) FROM lineitem
  UNION ALL SELECT 'l_extendedprice', COUNT(*) FILTER (l_extendedprice < 0) FROM lineitem)""",
    "dq_grain_unique": """SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem
GROUP BY 1, 2 HAVING COUNT(*) > 1""",
    "dq_grain_report": """SELECT 'grain' AS "check", 'lineitem' AS dataset,
  'l_orderkey,l_linenumber' AS "column", COUNT(*) AS n_bad, COUNT(*) = 0 AS passed
FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1)
UNION ALL SELECT 'grain', 'orders', 'o_orderkey', COUNT(*), COUNT(*) = 0
FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING COUNT(*) > 1)""",
    "dq_quarantine": """SELECT c_custkey, c_acctbal,
  CASE WHEN reasons = '' THEN 'good' ELSE 'bad' END AS status, reasons FROM (
  SELECT *, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'negative_balance' END,
    CASE WHEN c_acctbal < 500 THEN 'low_balance' END,
    CASE WHEN c_mktsegment IS NULL THEN 'no_segment' END) AS reasons FROM customer)""",
    "dq_quarantine_table": """SELECT CASE WHEN c_acctbal < 500 OR c_mktsegment IS NULL THEN 'bad'
  ELSE 'good' END AS dq_status, COUNT(*) AS n FROM customer GROUP BY 1""",
    "availability": """SELECT 'customer' AS dataset, COUNT(*) > 0 AS available FROM customer
UNION ALL SELECT 'supplier', COUNT(*) > 0 FROM supplier
UNION ALL SELECT 'orders', COUNT(*) > 0 FROM orders
UNION ALL SELECT 'lineitem', COUNT(*) > 0 FROM lineitem
UNION ALL SELECT 'events', COUNT(*) > 0 FROM events
UNION ALL SELECT 'documents', COUNT(*) > 0 FROM documents
UNION ALL SELECT 'events_none', COUNT(*) > 0 FROM events WHERE event_type = 'none'""",
    "run_summary": f"WITH {RUNS} SELECT * FROM summary",
    "run_gate": f"""WITH {RUNS} SELECT *, CASE WHEN status <> 'success' THEN 'fail'
  WHEN total_records = 0 THEN 'warn' ELSE 'pass' END AS gate FROM summary""",
    "run_manifest": f"""WITH {RUNS} SELECT dataset_name, '2024-02-01_06-00-00' AS ingestion_datetime,
  'silver' AS endpoint, n_records, 'success' AS status FROM runs WHERE endpoint = 'TypedDataSet'""",
    "freshness": """SELECT event_type, last_seen, age_hours, age_hours <= 1 AS is_fresh FROM (
  SELECT event_type, MAX(ts) AS last_seen,
         CAST(floor(epoch(TIMESTAMP '2024-01-31' - MAX(ts)) / 3600) AS BIGINT) AS age_hours
  FROM events GROUP BY 1)""",
    "latency": """SELECT CAST(year(o_orderdate) AS INT) AS period_code, COUNT(*) AS n,
  CAST(SUM(date_diff('day', o_orderdate, l_shipdate)) AS DOUBLE) / COUNT(*) AS avg_days,
  quantile_cont(date_diff('day', o_orderdate, l_shipdate), 0.95) AS p95_days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
    "latency_distribution": """WITH delays AS (
  SELECT CAST(year(o_orderdate) AS INT) AS period_code, date_diff('microsecond', o_orderdate::TIMESTAMP,
    l_shipdate::TIMESTAMP + to_hours(l_orderkey % 24) + to_minutes(l_linenumber)) AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
cut AS (SELECT period_code, abs(v) AS v, CASE WHEN v < 0 THEN -1 ELSE 1 END AS side,
               greatest(0, length(bin(abs(v))) - 8) AS s FROM delays),
b AS (SELECT period_code, side * ((v >> s) << s) AS bucket, side, s, count(*) AS n FROM cut GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY period_code ORDER BY bucket) AS upto,
             sum(n) OVER (PARTITION BY period_code) AS whole,
             side * ((abs(bucket) + CASE WHEN s > 0 THEN (1::BIGINT << s) / 2 ELSE 0 END) / 1e6) AS value
      FROM b)
SELECT period_code, max(whole)::BIGINT AS n,
  min(value) FILTER (upto >= ceil(whole * 0.5)) AS p50_seconds,
  min(value) FILTER (upto >= ceil(whole * 0.95)) AS p95_seconds,
  min(value) FILTER (upto >= ceil(whole * 0.99)) AS p99_seconds
FROM c GROUP BY period_code""",
    "lineage_reachable": """WITH RECURSIVE e AS (
  SELECT 'region:' || n_regionkey AS a, 'nation:' || n_nationkey AS b FROM nation UNION
  SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer UNION
  SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier UNION
  SELECT 'supplier:' || l_suppkey, 'flag:' || l_returnflag FROM lineitem),
r AS (SELECT a, b, 1 AS hops FROM e UNION SELECT r.a, e.b, hops + 1 FROM r JOIN e ON r.b = e.a)
SELECT a AS source, b AS target, min(hops)::INTEGER AS hops FROM r GROUP BY a, b""",
    "failure_rate": """SELECT strftime(ts, '%Y-%m-%d') AS day, COUNT(*) AS n,
  COUNT(*) FILTER (event_type = 'error') AS failures,
  CAST(COUNT(*) FILTER (event_type = 'error') AS DOUBLE) / COUNT(*) AS rate FROM events GROUP BY 1""",
    "layer_reconcile": f"""WITH {LAYERS}
SELECT 'lineitem' AS dataset, 'bronze' AS from_layer, 'silver' AS to_layer, bronze AS n_in,
       silver AS n_kept, bronze - silver AS n_dropped FROM layers
UNION ALL SELECT 'lineitem', 'silver', 'gold', silver, gold, silver - gold FROM layers""",
    "lineage_edges": f"""WITH {LAYERS}
SELECT 'lineitem' AS dataset, 'bronze_lineitem' AS from_table, 'silver_lineitem' AS to_table,
       bronze AS n_in, silver AS n_kept FROM layers
UNION ALL SELECT 'lineitem', 'silver_lineitem', 'gold_supplier_year', silver, gold FROM layers""",
    "sums_of_fine_and_large_values": """SELECT l_returnflag, l_linestatus,
  EXACT_SUM(fine) AS sum_fine, EXACT_SUM(fine) / COUNT(fine) AS avg_fine,
  SUM(large) AS sum_large
FROM (SELECT *, l_extendedprice * l_discount / 3 AS fine, 144115188075855872.0::DOUBLE AS large FROM lineitem)
GROUP BY 1, 2""",
    # streaming
    "stream_to_silver": CLEAN_EVENT,
    "stream_layers": """SELECT 'bronze' AS layer, event_type, COUNT(*) AS n FROM events GROUP BY 2
UNION ALL SELECT 'silver', event_type, COUNT(*) FROM events WHERE event_type <> 'error' GROUP BY 2""",
    "stream_minute_facts": MINUTES,
    "stream_minute_facts_compacted": MINUTES,
    "stream_dedupe": "SELECT * FROM events",
    "stream_upsert_latest": LATEST_EVENT,
    # whole pipeline
    "landed_feeds": """SELECT 'bag_pand' AS feed, COUNT(*) AS n, CAST(SUM(s_suppkey) AS BIGINT) AS keys
FROM supplier UNION ALL SELECT 'daily_weather_all_stations', COUNT(*), CAST(SUM(event_id) AS BIGINT)
FROM events UNION ALL SELECT 'current_traffic_sample', COUNT(*), CAST(SUM(s_suppkey) AS BIGINT)
FROM supplier""",
    "medallion_tables": f"""WITH {ORC},
facts AS (SELECT COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS n_regions
          FROM (SELECT DISTINCT o_custkey, period_code FROM orc)),
stock AS (SELECT COUNT(*) AS n, COUNT(DISTINCT o_custkey) AS n_regions
          FROM (SELECT DISTINCT o_custkey, period_code, o_orderpriority FROM orc))
SELECT 'gold_cbs_neighbourhood_analysis' AS gold_table, * FROM facts
UNION ALL SELECT 'gold_cbs_property_value_trends', * FROM facts
UNION ALL SELECT 'gold_cbs_socioeconomic_indicators', * FROM facts
UNION ALL SELECT 'gold_regional_dashboard', * FROM facts
UNION ALL SELECT 'gold_cbs_housing_market_analysis', * FROM stock""",
    "medallion_market": f"""WITH {ORC},
worth AS (SELECT o_custkey, period_code, MAX(o_totalprice) AS worth FROM orc GROUP BY 1, 2),
stock AS (SELECT o_custkey, period_code, o_orderpriority, COUNT(*) AS n FROM orc GROUP BY 1, 2, 3)
SELECT 'BU' || s.o_custkey AS "RegioS", 'Buurt ' || s.o_custkey AS "RegioNaam",
       s.period_code || 'JJ00' AS "Perioden", o_orderpriority AS "TypeWoning_3",
       CAST(n AS DOUBLE) AS avg_dwellings, n AS total_dwellings, worth AS avg_property_value,
       '2024-02-01' AS last_updated, 'gold_cbs_housing_market_analysis' AS gold_table
FROM stock s LEFT JOIN worth w ON s.o_custkey = w.o_custkey AND s.period_code = w.period_code""",
}

# Sums of doubles are compared exactly: added as decimals of their shortest text.
ORACLES = {name: re.sub(
    r"EXACT_SUM\(([^()]*)\)",
    r"CAST(CAST(SUM(CAST(CAST(\1 AS VARCHAR) AS DECIMAL(38,18))) AS VARCHAR) AS DOUBLE)", sql)
    for name, sql in ORACLES.items()}
