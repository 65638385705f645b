"""Every operator bound to the test tables: ``name -> f(spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polderlake.llm import (collocations, decontamination, exact_dedup, hard_negatives,
                            html_extract, language_id, line_dedup, lm_score, near_dedup, pii,
                            sentencepiece_lattice, token_output, toxicity)

from polderlake.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query
def op1_token_output(spark, d):
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    token_output.write_tokens(table(spark, d, "documents"), path,
                              public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.read_tokens(spark, path)


@query
def op5_exact_dedup(spark, d):
    return exact_dedup.exact_groups(spark, table(spark, d, "documents"))


ORACLES["op5_exact_dedup"] = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'))
             AS text_sha256
      FROM documents)
WINDOW w AS (PARTITION BY text_sha256)
"""


@query
def op10_personal_data(spark, d):
    return pii.digest(pii.find_personal_data(spark, table(spark, d, "documents")))


@query
def op8_decontamination(spark, d):
    return decontamination.flagged(spark, table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def op4_toxicity(spark, d):
    return toxicity.toxicity(spark, table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op3_near_dedup(spark, d):
    return near_dedup.near_classes(spark, table(spark, d, "documents"))


@query
def op2_line_dedup(spark, d):
    return line_dedup.line_counts(spark, table(spark, d, "documents"), **line_dedup.EVERY_LINE)


@query
def op6_html_extraction(spark, d):
    return html_extract.extract(spark, table(spark, d, "pages"))


@query
def op9_lm_scoring(spark, d):
    return lm_score.score(spark, table(spark, d, "documents"))


@query
def op7_sentencepiece(spark, d):
    import public_tokenizers

    pieces = sentencepiece_lattice.load(public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece_lattice.round_trip(table(spark, d, "documents"), pieces)


@query
def op12_collocations(spark, d):
    return collocations.collocations(spark, table(spark, d, "documents"))


ORACLES["op12_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w
  FROM pieces),
sized AS (SELECT lang, w, unnest(generate_series(1, least(5, len(w)))) AS m FROM worded),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM sized)),
totals AS (SELECT lang, count(*) AS n FROM grams WHERE m = 1 GROUP BY lang),
f AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, count(*) AS f
      FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 100),
parts AS (SELECT lang, f, w, m, unnest(generate_series(2, m - 1)) AS k FROM f WHERE m >= 3),
covers AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT lang, f, w, k, unnest(generate_series(1, m - k + 1)) AS i FROM parts)
  GROUP BY ALL),
alone AS (
  SELECT f.* FROM f LEFT JOIN covers USING (lang, phrase)
  WHERE m >= 2 AND (longer IS NULL OR 100 * longer < 100 * f)),
cuts AS (SELECT lang, phrase, m, w, f AS a, unnest(generate_series(1, m - 1)) AS k FROM alone),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n, k,
         CAST((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:c.m], ' ')
  JOIN totals t ON t.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM scored QUALIFY rank <= 2000
"""


@query
def op13_hard_negatives(spark, d):
    vectors = table(spark, d, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.usable(vectors.withColumn("label", noisy))
    return hard_negatives.mine(spark, rows, F.col("vec_id") % 100 == 0)


ORACLES["op13_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_dot_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id
                          ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
       s.other_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT s.same AND 30 * positive_score <= 100 * s.score
  AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10
"""


@query
def op11_language_id(spark, d):
    return language_id.identify(spark, table(spark, d, "documents"))
