"""Near-duplicate texts: ProbMinHash sketches, banding, verification, connected classes.

A text's features are its five-word shingles, weighed by 1.4 - 0.4 / count. Each feature is a
Poisson process of its weight's rate whose arrivals fall on random registers; a register keeps
the feature that arrived first, and a process stops once its clock passes the last register to
fill (ProbMinHash, Ertl 2020). Two sketches agree in a register with the texts' probability
Jaccard similarity. Bands of registers are the candidate keys; the shingle sets of candidates
are then compared exactly, so a reported link is one of Jaccard similarity 0.8 or more. As no
weight is more than 1.4 times another, sets of Jaccard similarity 0.8 have a probability Jaccard
similarity of 0.66 at the least, however often either text repeats parts of itself, and share one
of 24 bands of 4 registers with a chance of 1 - (1 - 0.66**4)**24 = 0.994 or more.

Exact copies are collapsed first and never meet again. In a bucket, the member that shares
most bands with others is compared with the rest, so a group of n near copies costs n
comparisons. Texts that still share a bucket with another class after that meet by an exact
prefix filter: with shingles ordered from rare to frequent, two similar texts share
one of their first few, which are mostly a text's own and seldom a common passage's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polderlake.llm.common import staged
from polderlake.llm.components import components
from polderlake.llm.exact_dedup import exact_groups

WORDS = 5
THRESHOLD = 0.8
BANDS = 24
ROWS = 4
REPEATS = 0.4  # what a shingle's repeats can add to its weight of 1
CELLS = 1 << 18  # of the table of shingle counts


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Hashes of all runs of five words; a shorter text is one shingle, also without words."""
    words = (text or "").lower().split() or [""]
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    total = np.full(n, len(words) if len(words) < WORDS else WORDS, np.uint64)
    for i in range(min(WORDS, len(h))):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n])
    return total


def sketches(sets: list[np.ndarray], registers: int) -> np.ndarray:
    """The register contents of each multiset of features, all texts at once."""
    features, weights, owner = [], [], []
    for i, s in enumerate(sets):
        values, counts = np.unique(s, return_counts=True)
        features.append(values)
        weights.append(1 + REPEATS * (1 - 1 / counts))
        owner.append(np.full(len(values), i))
    feature = np.concatenate([*features, np.empty(0, np.uint64)])
    weight = np.concatenate([*weights, np.empty(0)])
    doc = np.concatenate([*owner, np.empty(0, np.int64)]).astype(np.int64)
    first = np.full(len(sets) * registers, np.inf)
    kept = np.zeros(len(sets) * registers, np.uint64)
    clock = np.zeros(len(feature))
    arrival = 0
    while len(feature):
        arrival += 1
        r = mix(feature + np.uint64(arrival * 0x9E3779B97F4A7C15 % 2 ** 64))
        clock = clock - np.log(((r >> np.uint64(11)) + np.uint64(1)) * 2.0 ** -53) / weight
        cell = doc * registers + (mix(r + np.uint64(1)) % np.uint64(registers)).astype(np.int64)
        better = clock < first[cell]
        np.minimum.at(first, cell[better], clock[better])
        won = better & (clock == first[cell])
        kept[cell[won]] = feature[won]
        last = first.reshape(-1, registers).max(axis=1)
        active = clock < last[doc]
        feature, weight, doc, clock = feature[active], weight[active], doc[active], clock[active]
    return kept.reshape(len(sets), registers)


def band_keys(texts: list[str | None], hashes: WordHashes, bands: int, rows: int) -> list[list[int]]:
    """The keys under which each text meets others."""
    kept = sketches([shingles(t, hashes) for t in texts], bands * rows)
    kept = kept.reshape(len(texts), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(texts), bands))
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + kept[:, :, r])
    return key.astype(np.int64).tolist()


def _keyed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                keys = band_keys(batch.column(1).to_pylist(), hashes, bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, keys array<bigint>")


def _shingled(docs: DataFrame) -> DataFrame:
    """``doc_id, shingles``: the sorted set of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [np.unique(shingles(t, hashes)).astype(np.int64)
                    for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)])
            values = pa.array(np.concatenate([*sets, np.empty(0, np.int64)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.LargeListArray.from_arrays(pa.array(ends), values)
                 .cast(pa.list_(pa.int64()))], ["doc_id", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, shingles array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose shingle sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                small, large = sorted((len(x), len(y)))
                if small < threshold * large:
                    good.append(False)
                    continue
                both = len(x) + len(y) - len(np.union1d(x, y))
                good.append(both >= threshold * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"{c}_set"))
    return (pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_set", "b_set")
            .mapInArrow(run, f"a {kind}, b {kind}"))


def _rarity(spark: SparkSession, sets: DataFrame) -> np.ndarray:
    """Counts of shingles by hash cell, a table of fixed size; only the order comes from it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            values = batch.column(0).flatten().to_numpy()
            total += np.bincount(values & (CELLS - 1), minlength=CELLS)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    counts = np.zeros(CELLS, np.int64)
    for r in sets.select("shingles").mapInArrow(run, "cell long, n long").groupBy("cell").agg(
            F.sum("n").alias("n")).collect():
        counts[r["cell"]] = r["n"]
    return counts


def _prefix_pairs(spark: SparkSession, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of texts of different components that can be similar: all that are, and few others.

    Sets of sizes m <= n with similarity t share at least ceil(t * n) shingles, so among the
    first n - ceil(t * n) + 1 of either, in any common order, there is one in common.
    """
    rarity = spark.sparkContext.broadcast(_rarity(spark, sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = rarity.value
        for batch in batches:
            at, keys, place, size = [], [], [], []
            for i, s in enumerate(batch.column(2)):
                s = s.values.to_numpy()
                order = np.lexsort((s, counts[s & (CELLS - 1)]))
                first = order[:len(s) - int(np.ceil(threshold * len(s) - 1e-9)) + 1]
                at.append(np.full(len(first), i))
                keys.append(s[first])
                place.append(np.arange(len(first)))
                size.append(np.full(len(first), len(s)))
            join = lambda x: pa.array(np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64))
            rows = join(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), join(keys), join(place),
                 join(size)], ["doc_id", "component", "shingle", "place", "size"])

    kind = sets.schema["doc_id"].dataType.simpleString()
    first = staged(spark, sets.select("doc_id", "component", "shingles").mapInArrow(
        run, f"doc_id {kind}, component {kind}, shingle long, place long, size long"), "prefixes")
    mixed = staged(spark, first.groupBy("shingle").agg(
        F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low != high").select("shingle"), "mixed-shingles")
    first = staged(spark, first.join(mixed, "shingle", "left_semi"), "prefixes")
    other = first.select("shingle", *[F.col(c).alias(f"b_{c}") for c in
                                      ("doc_id", "component", "place", "size")])
    # The sizes must allow the similarity, and so must what is left after this place of either.
    return first.join(other, "shingle").where(
        "doc_id < b_doc_id AND component != b_component"
        f" AND least(size, b_size) >= {threshold} * greatest(size, b_size)"
        "  AND least(size - place, b_size - b_place)"
        f" >= {threshold} / (1 + {threshold}) * (size + b_size) - 1e-6").select(
        F.col("doc_id").alias("a"), F.col("b_doc_id").alias("b"))


def near_classes(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD,
                 bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: ``doc_id, class_id, class_size, kept``.

    Words are runs without white space, in lower case. A class is a connected set of texts
    that are equal or similar; its id is its smallest ``doc_id``, and that row stays. Texts of
    fewer than five words are similar only when their words are equal; null, empty and blank
    texts are equal to each other. Rows with the same id count as one document. A row without
    an id is a class of its own. Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    known = docs.where("doc_id IS NOT NULL")
    copies = staged(spark, exact_groups(spark, known).select("doc_id", "keep_id", "kept"), "copies")
    firsts = copies.where("kept").select("doc_id")
    member = staged(spark, _keyed(known, bands, rows).join(firsts, "doc_id", "left_semi")
                    .select("doc_id", F.explode("keys").alias("key")), "band-keys")

    # Buckets with company, and how much company each member has in all of its buckets.
    # Both sides of these joins are tables, so that adaptive execution can split a hot key.
    size = staged(spark, member.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    member = staged(spark, member.join(size, "key"), "bucket-members")
    degree = staged(spark, member.groupBy("doc_id").agg(F.sum("n").alias("degree")), "degrees")
    member = staged(spark, member.drop("n").join(degree, "doc_id"), "bucket-members")
    sets = staged(spark, _shingled(known.join(degree.select("doc_id"), "doc_id", "left_semi"))
                  .groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(
                      F.collect_list("shingles")))).alias("shingles")), "shingle-sets")

    # In each bucket the member with most company leads, and is compared with the others.
    lead = staged(spark, member.groupBy("key").agg(
        F.max(F.struct("degree", F.negative("doc_id").alias("low"))).alias("top")), "leads")
    pairs = member.join(lead, "key").select(
        F.negative("top.low").alias("lead"), "doc_id").where("lead != doc_id").select(
        F.least("lead", "doc_id").alias("a"), F.greatest("lead", "doc_id").alias("b"))
    links = staged(spark, _verified(pairs.distinct(), sets, threshold), "links")
    labels = components(spark, links)

    # Members of a bucket that are in different classes now meet by the prefix filter.
    now = staged(spark, member.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
                 .select("key", "doc_id", F.coalesce("component", "doc_id").alias("component")), "now")
    mixed = now.groupBy("key").agg(F.min("component").alias("low"),
                                   F.max("component").alias("high")).where("low != high")
    left = now.join(mixed.select("key"), "key", "left_semi").select("doc_id", "component").distinct()
    left = staged(spark, left.join(sets, "doc_id"), "residue")
    more = staged(spark, _verified(_prefix_pairs(spark, left, threshold).distinct(), sets, threshold),
                  "links")
    if more.limit(1).count():
        labels = components(spark, links.unionByName(more))

    near = copies.join(labels.withColumnRenamed("node", "keep_id"), "keep_id", "left").select(
        "doc_id", F.coalesce("component", "keep_id").alias("class_id"), "kept")
    near = staged(spark, near, "classes")
    sizes = staged(spark, near.groupBy("class_id").agg(F.count("*").alias("class_size")), "sizes")
    whole = near.join(sizes, "class_id").select(
        "doc_id", "class_id", "class_size",
        (F.col("kept") & (F.col("doc_id") == F.col("class_id"))).alias("kept"))
    alone = docs.where("doc_id IS NULL").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"),
        F.lit(True).alias("kept"))
    return whole.unionByName(alone)


def drop_near_copies(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest id; rows without an id stay."""
    gone = near_classes(spark, docs, **options).where("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
