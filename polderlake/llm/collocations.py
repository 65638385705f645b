"""Phrases whose words belong together, from Misra-Gries summaries.

1. Words are counted exactly per language. A phrase that occurs ``least`` times has only words
   that do, so other words cut the text for what follows.
2. Every task hashes its phrases of 2 to ``longest`` words, counts equal hashes and deals them
   to hash partitions. Each partition keeps one Misra-Gries summary, into which the tasks'
   counts are merged. Its capacity exceeds the partition's mass divided by ``least``, so what it
   ever takes from a counter stays below ``least`` and every phrase that occurs so often
   survives. A survivor's count plus what was taken is an upper bound; those whose bound is
   too low are dropped. The hashes of the rest go into a Bloom filter.
3. A second pass counts, by their text, the phrases that the filter holds. What else it lets
   through falls short of ``least`` and goes then: the counts are exact.

The number of partitions grows with the words: a summary needs some ``COUNTERS`` counters, and a
partition holds at most ``least`` times as many packed keys. Filters have 24 bits for each entry
and at most ``MAX_BITS``: a fuller one lets more phrases through to the exact counts and changes
no result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polderlake.llm.common import power_of_two, shuffle_partitions, staged
from polderlake.operators.joins import skew_safe_join

COUNTERS = 1 << 16  # counters that a summary needs when hashes fall evenly
MAX_BITS = 1 << 28  # 32 MiB, what is broadcast at most
SEGMENT = 1 << 13  # bits that travel together
CHUNK_CHARS, HELD = 500_000, 1 << 20
WORDS_HELD = 100_000  # words and phrases with their text that a task keeps, of all languages
PHRASES_A_BUCKET = 50_000
PHRASE_NAMES = ["lang", "phrase", "words", "n"]
PHRASE_TYPES = (pa.string(), pa.binary(), pa.int32(), pa.int64())

# What separates pieces, and letters that lose their case.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
BREAK = b"\xff"  # occurs in no UTF-8 text
PREPARED = bytes.maketrans(UPPER + PIECE_ENDS + b"\t", LOWER + BREAK * len(PIECE_ENDS) + b" ")


def tokens(text: bytes) -> list[bytes]:
    """Words of a text in order, with ``BREAK`` between pieces."""
    return text.translate(PREPARED).replace(BREAK, b" \xff ").split()


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    start = lang.encode() + BREAK
    return np.array([xxhash.xxh3_64_intdigest(start + w) for w in words], np.uint64)


def languages_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, bytes]]]:
    """Rows in lists of a bounded number of bytes (or of one longer text)."""
    part, size = [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = text.as_py()
            if part and size + len(raw) > CHUNK_CHARS:
                yield part
                part, size = [], 0
            part.append((lang, raw))
            size += len(raw)
    if part:
        yield part


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, n`` of every word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            while held:
                lang, c = held.popitem()
                c.pop(BREAK, None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()),
                     pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])

        for part in chunks(batches):
            for lang, text in part:
                held.setdefault(lang, Counter()).update(tokens(text))
            if sum(map(len, held.values())) > WORDS_HELD:
                yield from flushed()
        yield from flushed()

    return (docs.mapInArrow(run, "lang string, word binary, n long")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")))


# ---- bitmaps ----------------------------------------------------------------------------


def _packed(segments: DataFrame) -> DataFrame:
    """``segment, bits`` (bytes) from ``segment, at`` (lists of places)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in batch.column(1):
                bits = np.zeros(SEGMENT, bool)
                bits[at.values.to_numpy()] = True
                out.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())],
                                             ["segment", "bits"])
    return segments.mapInArrow(run, "segment long, bits binary")


def bitmap(marks: DataFrame, bits: int) -> np.ndarray:
    """Bits set at the places ``mark``; at most ``bits`` of them reach the driver, packed."""
    segments = marks.groupBy(F.expr(f"mark div {SEGMENT}").alias("segment")).agg(
        F.collect_set((F.col("mark") % SEGMENT).cast("int")).alias("at"))
    out = np.zeros(bits // 8, np.uint8)
    for row in _packed(segments).toLocalIterator():
        a = row["segment"] * SEGMENT // 8
        out[a:a + SEGMENT // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def bits_for(entries: int) -> int:
    return max(SEGMENT, min(MAX_BITS, power_of_two(24 * entries)))


# Odd factors, the usual constants of 64-bit mixing: each gives a hash another place.
FACTORS = tuple(np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def place(hashes: np.ndarray, factor: np.uint64, bits: int) -> np.ndarray:
    h = hashes * factor
    return ((h ^ h >> np.uint64(32)) * factor >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """All places of all hashes."""
    return np.unique(np.concatenate([place(hashes, f, bits) for f in FACTORS]))


def is_set(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    left = np.arange(len(hashes))
    for f in FACTORS:
        at = place(hashes[left], f, 8 * len(bitmap))
        left = left[(bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
    out = np.zeros(len(hashes), bool)
    out[left] = True
    return out


def marks(hashes: DataFrame, bits: int) -> DataFrame:
    """``mark``: places to set for a column of hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(places(batch.column(0).to_numpy().view(np.uint64), bits))], ["mark"])
    return hashes.mapInArrow(run, "mark long")


def word_marks(words: DataFrame, bits: int) -> DataFrame:
    """``mark``: places to set for words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, word in zip(*(c.to_pylist() for c in batch.columns)):
                by_lang.setdefault(lang, []).append(word)
            for lang, of_lang in by_lang.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(places(word_hashes(lang, of_lang), bits))], ["mark"])
    return words.select("lang", "word").mapInArrow(run, "mark long")


# ---- phrases of a task ------------------------------------------------------------------


class Words:
    """Ids of a task's frequent words; 0 stands for whatever cuts a text."""

    def __init__(self, frequent: np.ndarray):
        self.frequent = frequent
        self.words, self.langs, self.hashes = [b""], [""], np.zeros(1, np.uint64)
        self.by_lang: dict[str, dict[bytes, int]] = {}

    def known(self, lang: str, met: list[bytes]) -> dict[bytes, int]:
        """Ids of a language's words, with those of ``met`` among them."""
        ids = self.by_lang.setdefault(lang, {BREAK: 0})
        new = list(set(met) - ids.keys())
        if sum(map(len, self.by_lang.values())) + len(new) > WORDS_HELD + len(self.words):
            for other, held in self.by_lang.items():  # forget rare ones, keep the ids given out
                self.by_lang[other] = {w: i for w, i in held.items() if i or w == BREAK}
            ids = self.by_lang[lang]
            new = list(set(met) - ids.keys())
        hashes = word_hashes(lang, new)
        often = is_set(self.frequent, hashes)
        ids.update(dict.fromkeys(new, 0))
        for i in np.flatnonzero(often):
            ids[new[i]] = len(self.words)
            self.words.append(new[i])
            self.langs.append(lang)
        self.hashes = np.concatenate([self.hashes, hashes[often]])
        return ids


def stream(words: Words, part: list[tuple[str, bytes]]) -> np.ndarray:
    """Word ids of the texts, with a cut around each."""
    by_lang: dict[str, list[bytes]] = {}
    for lang, text in part:
        by_lang.setdefault(lang, []).append(text)
    out = [np.zeros(1, np.int64)]
    for lang, texts in by_lang.items():
        met = tokens(BREAK.join([*texts, b""]))
        out.append(np.fromiter(map(words.known(lang, met).__getitem__, met), np.int64, len(met)))
    return np.concatenate(out)


def mixed(hashes: np.ndarray, next_word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its first words and that of its last."""
    h = (hashes * np.uint64(0x9E3779B97F4A7C15)) ^ next_word
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def phrase_hashes(ids: np.ndarray, hashes: np.ndarray, longest: int, drop: np.uint64,
                  only: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For 2 to ``longest`` words: where phrases start, and the bits kept of their hashes. With a
    filter only phrases that it holds, which start and end with such phrases."""
    at = np.flatnonzero(ids)
    held = np.ones(len(ids) + 1, bool)
    h = hashes[ids[at]]
    for n in range(2, longest + 1):
        goes_on = ids[np.minimum(at + n - 1, len(ids) - 1)] != 0  # the last id is a cut
        at, h = at[goes_on], h[goes_on]
        h = mixed(h, hashes[ids[at + n - 1]])
        if only is not None:
            ends = held[at + 1]
            at, h = at[ends], h[ends]
            hit = is_set(only, h >> drop)
            at, h = at[hit], h[hit]
            held[:] = False
            held[at] = True
        yield n, at, h >> drop


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def merged(keys: np.ndarray, counts: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their counts with one more for each of ``new``, which is sorted in place."""
    new.sort()
    first = np.flatnonzero(np.r_[True, new[1:] != new[:-1]]) if len(new) else np.zeros(0, int)
    times = np.diff(np.append(first, len(new)))
    new = new[first]
    at = np.searchsorted(keys, new)
    met = np.zeros(len(new), bool)
    inside = at < len(keys)
    met[inside] = keys[at[inside]] == new[inside]
    counts[at[met]] += times[met]
    at, new, times = at[~met], new[~met], times[~met]
    return np.insert(keys, at, new), np.insert(counts, at, times)


def dropped_bits(partitions: int) -> np.uint64:
    """A hash is kept without so many of its last bits: the partition's, and 32 for the key."""
    return np.uint64(32 - (partitions.bit_length() - 1))


def partitioned_counts(docs: DataFrame, frequent, longest: int, partitions: int) -> DataFrame:
    """``part, mass, keys, many, counts``: each task's phrase counts, packed by hash partition.

    A partition is the first bits of the hash, a key the 32 bits that follow; counts are listed
    for the keys (by place) that were met more than once. What a partition holds does not grow
    with the corpus, so neither does the share of keys that two phrases have in common.
    """
    drop = dropped_bits(partitions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(frequent.value)
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def flushed() -> pa.RecordBatch:
            cuts = np.searchsorted(keys, np.arange(partitions + 1, dtype=np.uint64) << np.uint64(32))
            rows = []
            for p in np.flatnonzero(np.diff(cuts)):
                k, c = keys[cuts[p]:cuts[p + 1]], counts[cuts[p]:cuts[p + 1]]
                many = np.flatnonzero(c > 1)
                rows.append((int(p), int(c.sum()), k.astype(np.uint32).tobytes(),
                             many.astype(np.uint32).tobytes(), c[many].astype(np.uint32).tobytes()))
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            columns = zip(*rows) if rows else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                              ["part", "mass", "keys", "many", "counts"])

        for part in chunks(batches):
            ids = stream(words, part)
            keys, counts = merged(keys, counts, np.concatenate(
                [h for _, _, h in phrase_hashes(ids, words.hashes, longest, drop)]))
            if len(keys) > HELD or counts.sum() >> 31:
                yield flushed()
                keys, counts = keys[:0], counts[:0]
        yield flushed()

    return docs.mapInArrow(run, "part int, mass long, keys binary, many binary, counts binary")


def unpacked(keys: bytes, many: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(keys, np.uint32).astype(np.uint64)
    each = np.ones(len(keys), np.int64)
    each[np.frombuffer(many, np.uint32)] = np.frombuffer(counts, np.uint32)
    return keys, each


class Summary:
    """A mergeable Misra-Gries summary: ``capacity`` counters, and what was taken from each."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = summed(np.concatenate([self.keys, keys]),
                                        np.concatenate([self.counts, counts]))
        over = len(self.keys) - self.capacity
        if over > 0:  # the largest count beyond the capacity is taken from all
            cut = int(np.partition(self.counts, over - 1)[over - 1])
            self.taken += cut
            left = self.counts > cut
            self.keys, self.counts = self.keys[left], self.counts[left] - cut

    def at_least(self, least: int) -> np.ndarray:
        """Every key that occurs so often, if mass / (capacity + 1) is below ``least``."""
        return self.keys[self.counts + self.taken >= least]


def survivors(packed: DataFrame, least: int, partitions: int) -> DataFrame:
    """``hash``: the kept bits of every hash that survives its partition's summary.

    A partition's packed counts are held until its mass is known, which fixes the capacity.
    """
    def of_partition(part: int, rows: list) -> pa.RecordBatch:
        summary = Summary(sum(mass for mass, *_ in rows) // least + 1)
        waiting, held = [], 0
        for i, (_, *row) in enumerate(rows):
            waiting.append(unpacked(*row))
            held += len(waiting[-1][0])
            if held > HELD or i == len(rows) - 1:
                summary.merge(*map(np.concatenate, zip(*waiting)))
                waiting, held = [], 0
        whole = summary.at_least(least) | np.uint64(part) << np.uint64(32)
        return pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64))], ["hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for batch in batches:
            for p, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and p != part:
                    yield of_partition(part, rows)
                    rows = []
                part = p
                rows.append(row)
        if rows:
            yield of_partition(part, rows)

    return (packed.repartition(partitions, "part").sortWithinPartitions("part")
            .mapInArrow(run, "hash long"))


def exact_counts(docs: DataFrame, frequent, chosen, longest: int, partitions: int,
                 buckets: int) -> DataFrame:
    """``lang, phrase, words, n`` of every phrase that the filter ``chosen`` holds.

    A task sends its counts packed, one row for each bucket of phrases; a bucket's rows are
    added up where they meet.
    """
    drop = dropped_bits(partitions)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(frequent.value)
        held: dict[bytes, int] = {}  # by the ids of a phrase's words, packed

        def flushed() -> pa.RecordBatch:
            keys = [np.frombuffer(key, np.int32).tolist() for key in held]
            counts = np.fromiter(held.values(), np.int64, len(held))
            held.clear()
            phrases = [b" ".join(map(words.words.__getitem__, key)) for key in keys]
            bucket = np.fromiter((zlib.crc32(p) % buckets for p in phrases), np.int64, len(phrases))
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else bucket
            bounds = pa.array(np.append(cuts, len(bucket)), pa.int32())
            columns = ([words.langs[key[0]] for key in keys], phrases, list(map(len, keys)), counts)
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[cuts], pa.int32()),
                 *(pa.ListArray.from_arrays(bounds, pa.array(c, t).take(pa.array(order)))
                   for c, t in zip(columns, PHRASE_TYPES))],
                ["bucket", *PHRASE_NAMES])

        for part in chunks(batches):
            ids = stream(words, part)
            dense, vocabulary = ids, len(words.words)
            for n, at, _ in phrase_hashes(ids, words.hashes, longest, drop, chosen.value):
                # A phrase's number is that of its first words times the vocabulary, plus its
                # last word: equal numbers are equal phrases, without a hash.
                number = dense[at] * vocabulary + ids[at + n - 1]
                _, first, of, counts = np.unique(number, return_index=True, return_inverse=True,
                                                 return_counts=True)
                dense = np.zeros(len(ids), np.int64)
                dense[at] = of
                starts = at[first]
                packed = ids[starts[:, None] + np.arange(n)].astype(np.int32).view(f"V{4 * n}")
                for key, times in zip(packed.ravel().tolist(), counts.tolist()):
                    held[key] = held.get(key, 0) + times
            if len(held) > WORDS_HELD:
                yield flushed()
        yield flushed()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, total = None, Counter()

        def added() -> pa.RecordBatch:
            columns = zip(*((*key, n) for key, n in total.items())) if total else [()] * 4
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, PHRASE_TYPES)], PHRASE_NAMES)

        for batch in batches:
            for i, b in enumerate(batch.column(0).to_pylist()):
                if b != bucket:
                    yield added()
                    bucket, total = b, Counter()
                *key, n = (batch.column(c)[i].values.to_pylist() for c in range(1, 5))
                total.update(dict(zip(zip(*key), n)))
        yield added()

    packed = docs.mapInArrow(count, "bucket int, lang array<string>, phrase array<binary>, "
                                    "words array<int>, n array<long>")
    return (packed.repartition(buckets, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(add, "lang string, phrase binary, words int, n long"))


# ---- phrases of the corpus --------------------------------------------------------------


def frequent_phrases(spark: SparkSession, docs: DataFrame, least: int,
                     longest: int) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, n`` of all words and phrases that occur ``least`` times, and
    ``lang, total``: all word occurrences."""
    docs = languages_and_texts(docs)
    words = staged(spark, word_counts(docs), "phrase-words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    common = words.where(F.col("n") >= least)
    size = words.agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") >= least, 1)).alias("common")).first()
    bits = bits_for(size["common"])
    frequent = spark.sparkContext.broadcast(bitmap(word_marks(common, bits), bits))
    most = (longest - 1) * (size["n"] or 0)  # phrases there can be
    partitions = power_of_two(max(most / (least * COUNTERS), shuffle_partitions(spark)))
    chosen = staged(spark, survivors(partitioned_counts(docs, frequent, longest, partitions),
                                     least, partitions), "phrase-hashes")
    survived = chosen.count()
    bits = bits_for(survived)
    held = spark.sparkContext.broadcast(bitmap(marks(chosen, bits), bits))
    buckets = power_of_two(max(survived / PHRASES_A_BUCKET, shuffle_partitions(spark)))
    phrases = exact_counts(docs, frequent, held, longest, partitions, buckets).where(
        F.col("n") >= least)
    both = common.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "n")
    return (staged(spark, both.unionByName(phrases).withColumn(
        "phrase", F.col("phrase").cast("string")), "phrases"), totals)


def _span(words: Column, first: Column | int, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(spark: SparkSession, docs: DataFrame, least: int = 100, longest: int = 5,
                 top: int = 2_000, absorbed_percent: int = 100) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases.

    A null text is empty, a null language is ``und``; texts without words and empty tables give
    no rows. Repeated rows count each time; columns other than ``text`` and ``lang`` are not
    read. A phrase is dropped where a longer frequent one that holds it occurs in
    ``absorbed_percent`` of its occurrences. Ties in the score go by ``a``, then by the phrase's
    bytes; ties between cuts to the earliest.
    """
    counted, totals = frequent_phrases(spark, docs, least, longest)
    words = F.split("phrase", " ")
    phrases = counted.where(F.col("words") >= 2).select("lang", "phrase", "words", F.col("n").alias("a"))

    inner = F.explode(F.expr("flatten(transform(sequence(2, words - 1), m -> transform("
                             "sequence(1, words - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))"))
    covers = (phrases.where(F.col("words") >= 3).select("lang", inner.alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    alone = phrases.join(covers, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * absorbed_percent))

    cuts = alone.select("lang", "phrase", "words", "a",
                        F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"head": _span(words, 1, F.col("k")),
                             "tail": _span(words, F.col("k") + 1, F.col("words") - F.col("k"))})
    side = lambda part, n: counted.select("lang", F.col("phrase").alias(part), F.col("n").alias(n))
    cuts = skew_safe_join(cuts, side("head", "l"), ["lang", "head"], "inner")
    cuts = skew_safe_join(cuts, side("tail", "r"), ["lang", "tail"], "inner")
    cuts = skew_safe_join(cuts, totals.withColumnRenamed("total", "n"), ["lang"], "inner")
    wide = "cast({} as decimal(38,0))".format
    score = F.expr(f"({wide('1000')} * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    scored = (cuts.withColumn("score", score).groupBy("lang", "phrase")
              .agg(F.first("a").alias("a"), F.first("n").alias("n"),
                   F.min(F.struct("score", "k", "l", "r")).alias("cut"))
              .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
    # The best of a language first within each of many hash shares, then over them.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(max(8, shuffle_partitions(spark))))
    first = Window.partitionBy("lang", "share").orderBy(*order)
    return (scored.withColumn("share", share).withColumn("rank", F.row_number().over(first))
            .where(F.col("rank") <= top)
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))
                        .cast("long"))
            .where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
