"""Language of a text by a byte convolutional network, trained here in numpy.

A text's UTF-8 bytes are cut into windows of a fixed length, the last one padded. A byte is
embedded; filters of several widths slide over the window, each keeps its largest answer (max
pooling), and a softmax over the languages reads those. A text's chances are the mean over all
its windows, weighed by their bytes.

Filters of a trained network are applied by lookup: the answer of a filter is a sum of one
number for each of its bytes, and pairs of neighbouring bytes are looked up at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WINDOW = 192  # bytes
WIDTHS, FILTERS = (2, 4, 6), 12  # even widths: looked up in pairs of bytes
EMBED = 8
#: Labelled rows that the network learns from at most, shared evenly between the languages,
#: and the windows of each, spread over the whole text.
MAX_LABELLED, WINDOWS_EACH = 4_000, 4
EPOCHS, BATCH, RATE = 4, 64, 0.01
BATCH_WINDOWS = 256


@dataclass
class Network:
    """Weights, and the languages in the order of the outputs."""

    languages: list[str]
    weights: dict[str, np.ndarray]


def start(n_languages: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(11)
    net = {"embed": r.normal(0, 0.5, (256, EMBED)).astype(np.float32),
           "out": r.normal(0, 0.1, (len(WIDTHS) * FILTERS, n_languages)).astype(np.float32),
           "out_bias": np.zeros(n_languages, np.float32)}
    for w in WIDTHS:
        net[f"filter{w}"] = r.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)).astype(np.float32)
    return net


def windows_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts (padded with zeros), the text of each, and the bytes it holds."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    sizes = np.diff(offsets)
    each = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), each)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    first = offsets[:-1][owner] + nth * WINDOW
    held = np.minimum(sizes[owner] - nth * WINDOW, WINDOW)
    at = first[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < held[:, None]
    cut = np.zeros(at.shape, np.uint8)
    cut[inside] = data[at[inside]]
    return cut, owner, held


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def convolved(net: dict, cut: np.ndarray, width: int) -> np.ndarray:
    """Answers of the filters of one width: windows x places x filters."""
    places = WINDOW - width + 1
    seen = np.lib.stride_tricks.sliding_window_view(net["embed"][cut], width, axis=1)
    flat = seen[:, :places].transpose(0, 1, 3, 2).reshape(-1, width * EMBED)
    return (flat @ net[f"filter{width}"].reshape(-1, FILTERS)).reshape(len(cut), places, FILTERS)


def forward(net: dict, cut: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]:
    """Pooled answers, the place of each largest one by width, and the chances."""
    pooled, where = [], {}
    for w in WIDTHS:
        answers = convolved(net, cut, w)
        where[w] = answers.argmax(axis=1)
        pooled.append(np.take_along_axis(answers, where[w][:, None], axis=1)[:, 0])
    pooled = np.maximum(np.concatenate(pooled, axis=1), 0)
    return pooled, where, softmax(pooled @ net["out"] + net["out_bias"])


def gradients(net: dict, cut: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross entropy; only the place of each largest answer has a share."""
    pooled, where, chance = forward(net, cut)
    off = chance
    off[np.arange(len(cut)), label] -= 1
    off /= len(cut)
    out = {"out": pooled.T @ off, "out_bias": off.sum(axis=0), "embed": np.zeros_like(net["embed"])}
    back = (off @ net["out"].T) * (pooled > 0)
    for i, w in enumerate(WIDTHS):
        g = back[:, i * FILTERS:(i + 1) * FILTERS]  # windows x filters
        at = where[w][:, :, None] + np.arange(w)
        bytes_ = np.take_along_axis(cut, at.reshape(len(cut), -1), axis=1).reshape(at.shape)
        near = net["embed"][bytes_]  # windows x filters x width x embedding
        out[f"filter{w}"] = np.einsum("bf,bfwe->wef", g, near)
        share = g[:, :, None, None] * net[f"filter{w}"].transpose(2, 0, 1)
        np.add.at(out["embed"], bytes_.ravel(), share.reshape(-1, EMBED))
    return out


def train(cut: np.ndarray, label: np.ndarray, n_languages: int) -> dict[str, np.ndarray]:
    """Adam over shuffled batches; windows of rare languages are drawn as often as others."""
    net, r = start(n_languages), np.random.default_rng(13)
    mean = {k: np.zeros_like(v) for k, v in net.items()}
    square = {k: np.zeros_like(v) for k, v in net.items()}
    share = 1 / np.bincount(label, minlength=n_languages)[label]
    steps = -(-len(cut) // BATCH) * EPOCHS
    for step in range(1, steps + 1):
        part = r.choice(len(cut), BATCH, p=share / share.sum())
        rate = RATE * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
        for k, g in gradients(net, cut[part], label[part]).items():
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.001 * (g * g - square[k])
            net[k] -= rate * mean[k] / (np.sqrt(square[k]) + 1e-8)
    return net


def training_rows(docs: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``lang, text`` of a bounded, even sample of the labelled rows outside the held-out fifth.

    Rows without a language, a text or a letter teach nothing. Each language has the same number
    at most: its first rows by the hash of the id. A share of the hashes that holds about twice
    as many is taken first, so that the ranking never moves the texts of the corpus.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")
                      & has_letter("text")).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    known = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))  # one row per language
    each = max(1, max_labelled // max(1, known.count()))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    return (rows.join(F.broadcast(known), "lang").where(at * F.col("rows") < 2 * each + 50)
            .withColumn("place", F.row_number().over(order)).where(F.col("place") <= each)
            .select("lang", F.col("text").cast("binary").alias("text")))


def held_out(doc_id: str) -> F.Column:
    """The fifth of the ids that nothing is learned from; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def has_letter(text: str) -> F.Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def _spread(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``WINDOWS_EACH`` windows of each text, evenly over its length, and their texts."""
    cut, owner, _ = windows_of(texts)
    first = np.searchsorted(owner, np.arange(len(texts)))
    n = np.bincount(owner, minlength=len(texts))
    chosen = [first[i] + np.unique(np.linspace(0, n[i] - 1, min(WINDOWS_EACH, n[i])).astype(int))
              for i in range(len(texts)) if n[i]]
    at = np.concatenate(chosen) if chosen else np.zeros(0, int)
    return cut[at], owner[at]


def fit(docs: DataFrame, max_labelled: int = MAX_LABELLED) -> Network:
    """The network, from at most ``max_labelled`` texts; without any it knows no language.

    The windows are cut in tasks: the driver gets ``WINDOWS_EACH`` of them for each text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut, owner = _spread(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner)),
                 pa.array([c.tobytes() for c in cut], pa.binary())], ["lang", "cut"])

    rows = training_rows(docs, max_labelled).mapInArrow(run, "lang string, cut binary").collect()
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return Network([], {})
    rows.sort(key=lambda r: (r["lang"], bytes(r["cut"])))
    label = np.array([languages.index(r["lang"]) for r in rows])
    cut = np.frombuffer(b"".join(bytes(r["cut"]) for r in rows), np.uint8).reshape(-1, WINDOW)
    return Network(languages, train(cut, label, len(languages)))


def lookups(net: dict) -> dict[int, np.ndarray]:
    """For each width, the answers' share of every pair of bytes: pairs x (width / 2) x filters."""
    out = {}
    for w in WIDTHS:
        one = np.einsum("be,wef->wbf", net["embed"], net[f"filter{w}"])  # width x byte x filter
        pairs = one[0::2][:, :, None, :] + one[1::2][:, None, :, :]
        out[w] = pairs.reshape(w // 2, 256 * 256, FILTERS)
    return out


def chances(net: dict, tables: dict[int, np.ndarray], cut: np.ndarray) -> np.ndarray:
    """The same chances as ``forward`` gives, by lookup.

    The last product is of doubles: in singles a window's chances would depend in the eighth
    digit on the windows beside it, and so a score on how the rows are partitioned.
    """
    pair = cut[:, :-1].astype(np.int32) << 8 | cut[:, 1:]
    pooled = []
    for w in WIDTHS:
        places = WINDOW - w + 1
        answers = tables[w][0].take(pair[:, :places], axis=0)
        for k in range(1, w // 2):
            answers += tables[w][k].take(pair[:, 2 * k:2 * k + places], axis=0)
        pooled.append(answers.max(axis=1))
    pooled = np.maximum(np.concatenate(pooled, axis=1), 0).astype(np.float64)
    return softmax(pooled @ net["out"].astype(np.float64) + net["out_bias"])


def text_chances(net: Network, tables: dict, texts: pa.Array) -> np.ndarray:
    """Texts x languages; a text without bytes has none."""
    sums = np.zeros((len(texts), len(net.languages)))
    cut, owner, held = windows_of(texts)
    for a in range(0, len(cut), BATCH_WINDOWS):
        b = slice(a, a + BATCH_WINDOWS)
        part = chances(net.weights, tables, cut[b]) * held[b, None]
        for j in range(len(net.languages)):
            sums[:, j] += np.bincount(owner[b], part[:, j], len(texts))
    return sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-30)


def _parts(texts: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of a bounded number of bytes, or of one longer text."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t.as_buffer()) if t.is_valid else 0
        if i > a and size + n > most:
            yield a, i
            a, size = i, 0
        size += n
    if len(texts) > a:
        yield a, len(texts)


def predict(spark: SparkSession, docs: DataFrame, net: Network) -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score``.

    ``und`` with score 0.0 where the text is null or has no letter, or nothing was learned.
    The first language by name wins a tie. Every byte of a text counts; equal texts are
    predicted alike; columns other than ``doc_id`` and ``text`` are not read.
    """
    shared = spark.sparkContext.broadcast(net)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = lookups(net.weights) if net.languages else {}
        names = np.array(net.languages, dtype=object)
        for batch in batches:
            texts = batch.column(2)
            for a, b in _parts(texts):
                of = texts.slice(a, b - a)
                lettered = np.array([t.is_valid for t in of])
                lang = np.full(b - a, "und", object)
                score = np.zeros(b - a)
                if net.languages and lettered.any():
                    held = text_chances(net, tables, of.fill_null(b""))
                    best = held.argmax(axis=1)
                    lang[lettered] = names[best[lettered]]
                    score[lettered] = np.clip(held[np.arange(b - a), best][lettered], 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                     pa.array(lang, pa.string()), pa.array(score)],
                    ["doc_id", "held_out", "lang_pred", "score"])

    text = F.when(has_letter("text"), F.col("text").cast("binary"))
    return docs.select("doc_id", held_out("doc_id").alias("held_out"), text.alias("text")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(spark: SparkSession, docs: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``predict`` for all documents by a network learned from the same table's labels."""
    return predict(spark, docs, fit(docs, max_labelled))
