"""Benchmark decontamination: pigeonhole pieces, exact hits, Myers' bit-parallel distance.

An item of length n may occur in a text with up to ``k = floor(rate * n)`` edits. Cut into
k + m pieces, at least m pieces then occur unchanged, and where they place the item differs by
k at most, so every occurrence is found from the exact hits of the pieces. An Aho-Corasick
automaton finds the hits of all pieces in one pass over a text; where enough different pieces
agree, Myers' algorithm decides whether the item matches some part of that window within k
edits. Long items have more pieces than k + 1, so that short pieces that hit by chance do not
count alone.

The documents are read once for each block of items and never shuffled. A block is a bounded
number of items, so its automaton is small, however large the benchmark is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ERROR_RATE = 0.1
MIN_PIECE = 1  # a greater one takes edits from items that are too short for such pieces
PIECE = 8  # an item is cut finer than into k + 1 pieces down to this length
BLOCK_ITEMS = 5_000


def normalise(text: str | None) -> str:
    """Lower case, runs of white space as one space, ends trimmed."""
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float = ERROR_RATE, min_piece: int = MIN_PIECE) -> int:
    """Edits allowed for an item, no more than leave pieces of ``min_piece``."""
    return max(0, min(int(rate * length), length // min_piece - 1))


def pieces(item: str, n: int) -> list[tuple[int, str]]:
    """n consecutive pieces of even length with their places in the item."""
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def windows(hits: list[tuple[int, int]], k: int, least: int) -> Iterator[tuple[int, int]]:
    """First and last start of an item where ``least`` different pieces agree within k.

    ``hits`` are (start of the item, place of the piece in it).
    """
    hits = sorted(set(hits))
    some: Counter = Counter()
    last, run = 0, None
    for i, (start, at) in enumerate(hits):
        while last < len(hits) and hits[last][0] <= start + k:
            some[hits[last][1]] += 1
            last += 1
        if len(some) >= least:
            if run and start > run[1] + k:
                yield run
                run = None
            run = (run[0] if run else start, start)
        some[at] -= 1
        if not some[at]:
            del some[at]
    if run:
        yield run


def occurs(masks: dict[str, int], length: int, window: str, k: int) -> bool:
    """Whether some part of the window is within k edits of the item (Myers 1999).

    ``masks`` has for each character the bits of its places in the item. The item's column of
    edit distances is kept as bits of its rises and falls; the free start of the window lets a
    match begin anywhere.
    """
    full, top = (1 << length) - 1, 1 << (length - 1)
    rise, fall, score = full, 0, length
    for c in window:
        eq = masks.get(c, 0)
        same = (((eq & rise) + rise) ^ rise) | eq | fall
        up = fall | (full & ~(same | rise))
        down = rise & same
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score <= k:
                return True
        up = up << 1
        rise = (down << 1 | ~(same | up)) & full
        fall = up & same & full
    return False


class Matcher:
    """The items of one block, ready to search texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_piece: int):
        self.items: list[tuple[int, int, int, dict[str, int]]] = []  # length, edits, pieces
        self.ids: list[list[int]] = []
        known: dict[str, int] = {}
        hits: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if text in known:
                self.ids[known[text]].append(item_id)
                continue
            n = known[text] = len(self.items)
            k = budget(len(text), rate, min_piece)
            masks: dict[str, int] = {}
            for i, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << i
            cut = max(k + 1, len(text) // PIECE if k else 1)
            self.items.append((len(text), k, cut - k, masks))
            self.ids.append([item_id])
            for at, piece in pieces(text, cut):
                hits.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in hits.items():
            self.automaton.add_word(piece, (len(piece), places))
        if hits:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[int]:
        """Ids of the items that occur in a normalised text."""
        found: set[int] = set()
        if not self.items:
            return []
        hits: dict[int, list[tuple[int, int]]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for n, at in places:  # where the item would begin without edits
                hits.setdefault(n, []).append((end - size + 1 - at, at))
        for n, some in hits.items():
            length, k, least, masks = self.items[n]
            for first, last in windows(some, k, least) if len(some) >= least else ():
                window = text[max(0, first - k):last + length + k]
                if len(window) >= length - k and occurs(masks, length, window, k):
                    found.add(n)
                    break
        return sorted(i for n in found for i in self.ids[n])


def _blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple[int, str]]]:
    """Items with a text, in blocks of a bounded size; the driver holds one block at a time."""
    block: list[tuple[int, str]] = []
    for row in benchmark.select("item_id", "text").toLocalIterator():
        text = normalise(row["text"])
        if text and row["item_id"] is not None:
            block.append((row["item_id"], text))
            if len(block) == size:
                yield block
                block = []
    if block:
        yield block


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame,
                  rate: float = ERROR_RATE, min_piece: int = MIN_PIECE,
                  block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Contaminated rows: ``doc_id, item_ids`` (sorted), a row per input row with a match.

    Case and white space do not count. Null and empty items match nothing, nor do null and
    empty texts. Items with equal texts are all reported. Whole texts of any length are
    searched. Other columns of either table are not read. Repeated rows give repeated rows.
    """
    docs = docs.select("doc_id", "text")
    out = "doc_id " + docs.schema["doc_id"].dataType.simpleString() + ", item_ids array<bigint>"

    def search(matcher_of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of()
            for batch in batches:
                ids, found = [], []
                for doc_id, text in zip(batch.column(0), batch.column(1)):
                    if hits := matcher.search(normalise(text.as_py())):
                        ids.append(doc_id.as_py())
                        found.append(hits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch.schema.field(0).type), pa.array(found, pa.list_(pa.int64()))],
                    ["doc_id", "item_ids"])
        return run

    result = None
    for block in _blocks(benchmark, block_items):
        shared = spark.sparkContext.broadcast(block)
        found = docs.mapInArrow(
            search(lambda shared=shared: Matcher(shared.value, rate, min_piece)), out)
        result = found if result is None else result.unionByName(found)
    return spark.createDataFrame([], out) if result is None else result


def flagged(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document id: ``doc_id, n_items, item_ids, contaminated``.

    Rows that share an id share the row here; a null id is an id of its own.
    """
    hits = contamination(spark, docs, benchmark, **options).groupBy("doc_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    ids = docs.select("doc_id").distinct().withColumn("item_ids", F.expr("cast(array() AS array<bigint>)"))
    return hits.unionByName(ids).groupBy("doc_id").agg(
        F.max("item_ids").alias("item_ids")).select(
        "doc_id", F.size("item_ids").cast("long").alias("n_items"), "item_ids",
        (F.size("item_ids") > 0).alias("contaminated"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame,
                      **options) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; rows with no id stay."""
    bad = contamination(spark, docs, benchmark, **options).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")
