"""Language-model scores by masked pseudo-likelihood.

Every token of a text is predicted from the two tokens on either side of it, never from
itself, by a small window network trained here in numpy. The sum of the conditional log
probabilities is the text's pseudo-log-likelihood.

The vocabulary comes from word counts over all documents: the most frequent words are tokens
of their own, every other word falls into one of the rare-word tokens by its hash. A rare word
has the chance of its token given the window times its own share of the token's occurrences,
so no two words are scored alike for want of room. Training passes over all documents once:
each task trains the common start on its own share, and the tasks' networks are averaged,
weighed by their tokens. Scoring is one more pass.

The counts of all words stay a distributed table. Documents are cut into blocks of a bounded
size, once into words; from then on a text is the places of its words in the block's list of
distinct ones. A block joins that list to the table and gets back the shares of its rare words,
whose places are all of its texts that moves for it. Vocabulary and network grow with the number of distinct words (its square root), and
only they are broadcast.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polderlake.llm.common import staged

SIDE = 32  # a token is a cell of a square; the network predicts its row, then its column
VOCABULARY = SIDE * SIDE  # the least; it grows with the distinct words
RARE_SHARE = 16  # one in so many tokens stands for rarer words
BLOCK_DOCS, BLOCK_CHARS = 2_000, 4_000_000
OFFSETS = (-2, -1, 1, 2)
HIDDEN = 16
BATCH = 4_096
RATE = 0.01


def side_of(distinct: int) -> int:
    """Side of the square of tokens for so many distinct words."""
    return max(SIDE, math.ceil(distinct ** 0.25))


def rare_tokens(side: int) -> int:
    return side * side // RARE_SHARE


class Tokens(dict):
    """Token of each word; unknown words are remembered up to a bound."""

    def __init__(self, words: list[str], side: int = SIDE):
        super().__init__((w, i) for i, w in enumerate(words))
        self.known = dict(self)
        self.size, self.rare = side * side, rare_tokens(side)

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
            self.update(self.known)
        token = self[word] = self.size - self.rare + zlib.crc32(word.encode()) % self.rare
        return token


class Places(dict):
    """Place of each word among the distinct ones, in the order in which they first occur."""

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        return place


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def pack(places: np.ndarray, lengths: list[int] | np.ndarray, **columns: pa.Array) -> bytes:
    """Documents of a block, each the places of its words, compressed, as they cross a shuffle."""
    kind = np.uint16 if places.max(initial=0) < 1 << 16 else np.uint32
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    texts = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(places.astype(kind)))
    batch, sink = pa.RecordBatch.from_arrays([texts, *columns.values()], ["texts", *columns]), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(packed: pa.Scalar) -> tuple:
    """The places of all words in order, where each document begins and the last one ends, other columns."""
    texts, *columns = pa.ipc.open_stream(packed.as_buffer()).read_next_batch().columns
    return texts.values.to_numpy(), texts.offsets.to_numpy(), *columns


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each document's values, 0 without any."""
    out, some = np.zeros(len(bounds) - 1), np.diff(bounds) > 0
    if some.any():
        out[some] = np.add.reduceat(values, bounds[:-1][some])
    return out


def blocks(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``block, packed, words, counts``: documents in blocks, with each block's distinct words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column(1).to_pylist()
            a = 0
            while a < len(texts):
                b, chars = a, 0
                distinct, parts = Places(), [np.zeros(0, np.int32)]
                while b < len(texts) and b - a < BLOCK_DOCS and chars < BLOCK_CHARS:
                    words = words_of(texts[b])
                    parts.append(np.fromiter(map(distinct.__getitem__, words), np.int32, len(words)))
                    chars += len(texts[b] or "")
                    b += 1
                places = np.concatenate(parts)
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()),
                     pa.array([pack(places, list(map(len, parts[1:])), ids=batch.column(0).slice(a, b - a))]),
                     one(pa.array(list(distinct), pa.string())),
                     one(pa.array(np.bincount(places, minlength=len(distinct)), pa.int64()))],
                    ["block", "packed", "words", "counts"])
                block, a = block + 1, b

    return staged(spark, docs.select("doc_id", "text").mapInArrow(
        run, "block long, packed binary, words array<string>, counts array<long>"), "lm-blocks")


def word_counts(spark: SparkSession, cut: DataFrame) -> DataFrame:
    """``word, n``: the occurrences of every word of the corpus."""
    each = cut.select(F.explode(F.arrays_zip("words", "counts")).alias("w"))
    return staged(spark, each.groupBy(F.col("w.words").alias("word")).agg(
        F.sum("w.counts").alias("n")), "lm-words")


def vocabulary(counts: DataFrame, side: int) -> list[str]:
    """The most frequent words of all documents, ties by the word."""
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word")
            .limit(side * side - rare_tokens(side)).collect()]


def shares(spark: SparkSession, counts: DataFrame, words: list[str], side: int) -> DataFrame:
    """``word, share``: log of each rarer word's part in the occurrences of its token."""
    known = spark.createDataFrame([(w,) for w in words], "word string")
    rare = counts.join(F.broadcast(known), "word", "left_anti").withColumn(
        "token", F.crc32(F.col("word").cast("binary")) % rare_tokens(side))
    total = rare.groupBy("token").agg(F.sum("n").alias("total"))  # a row for each rare token
    return rare.join(F.broadcast(total), "token").select(
        "word", F.log(F.col("n") / F.col("total")).alias("share"))


def laid_out(tokens: np.ndarray, counts: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """Token ids with room for two neighbours around each text, and the places of tokens."""
    joined = np.full(len(tokens) + 2 * (len(counts) + 1), edge, np.int32)
    at = np.arange(len(tokens)) + np.repeat(2 * np.arange(1, len(counts) + 1), counts)
    joined[at] = tokens
    return joined, at


def stream(texts: list[str | None], tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Laid out token ids, places of tokens, their counts."""
    split = list(map(words_of, texts))
    counts = np.array(list(map(len, split)), np.int64)
    flat = np.fromiter((tokens[w] for words in split for w in words), np.int32, counts.sum())
    return *laid_out(flat, counts, tokens.size), counts


def tokens_of(words: pa.Scalar, tokens: Tokens) -> np.ndarray:
    """Token of each distinct word of a block."""
    return np.fromiter(map(tokens.__getitem__, words.as_py()), np.int32, len(words))


def start(side: int = SIDE) -> dict[str, np.ndarray]:
    """The network that every task starts from."""
    r = np.random.default_rng(17)
    return {"embed": r.normal(0, 0.1, (len(OFFSETS), side * side + 1, HIDDEN)).astype(np.float32),
            "bias": np.zeros(HIDDEN, np.float32),
            "to_row": r.normal(0, 0.1, (HIDDEN, side)).astype(np.float32),
            "row": np.zeros(side, np.float32),
            "to_column": r.normal(0, 0.1, (HIDDEN, side)).astype(np.float32),
            "column": np.zeros((side, side), np.float32)}


def _weights(x: np.ndarray) -> np.ndarray:
    np.clip(x, -40, 40, out=x)  # cheaper than each row's largest, and no network here gets there
    return np.exp(x, out=x)


def _totals(x: np.ndarray) -> np.ndarray:
    """Sum of each row, as a product."""
    return x @ np.ones(x.shape[1], x.dtype)


def weights(net: dict, ids: np.ndarray, at: np.ndarray):
    """Hidden layer, and what the chances of all rows and of all columns in the true row are in proportion to."""
    hidden = net["embed"][0].take(ids[at + OFFSETS[0]], axis=0)
    for k, o in enumerate(OFFSETS[1:], 1):
        hidden += net["embed"][k].take(ids[at + o], axis=0)
    hidden += net["bias"]
    np.tanh(hidden, out=hidden)
    row = ids[at] // len(net["row"])
    rows, columns = hidden @ net["to_row"], hidden @ net["to_column"]
    rows += net["row"]
    columns += net["column"].take(row, axis=0)
    return hidden, _weights(rows), _weights(columns)


def forward(net: dict, ids: np.ndarray, at: np.ndarray):
    """Hidden layer, and the chances of all rows and of all columns in the true row."""
    hidden, rows, columns = weights(net, ids, at)
    rows *= 1 / _totals(rows)[:, None]
    columns *= 1 / _totals(columns)[:, None]
    return hidden, rows, columns


def log_chances(net: dict, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log probability of the token at each place given its neighbours."""
    out, side = np.empty(len(at)), len(net["row"])
    for a in range(0, len(at), BATCH):
        part = at[a:a + BATCH]
        _, rows, columns = weights(net, ids, part)
        n, (row, column) = np.arange(len(part)), np.divmod(ids[part], side)
        out[a:a + len(part)] = np.log(rows[n, row] / _totals(rows) * (columns[n, column] / _totals(columns)))
    return out


def gradients(net: dict, ids: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean negative log probability."""
    hidden, rows, columns = forward(net, ids, at)
    n, true, side = np.arange(len(at)), ids[at], len(net["row"])
    rows[n, true // side] -= 1
    columns[n, true % side] -= 1
    rows *= 1 / len(at)
    columns *= 1 / len(at)
    back = (net["to_row"] @ rows.T + net["to_column"] @ columns.T) * (1 - hidden.T ** 2)
    embed = np.empty_like(net["embed"])
    bias, back = back.sum(axis=1), back.astype(np.float64)  # as bincount adds them
    for k, o in enumerate(OFFSETS):
        near = ids[at + o].astype(np.int64)
        for j in range(HIDDEN):
            embed[k, :, j] = np.bincount(near, back[j], side * side + 1)
    member = np.zeros((len(at), side), np.float32)
    member[n, true // side] = 1
    column = member.T @ columns
    return {"embed": embed, "bias": bias, "to_row": hidden.T @ rows,
            "row": rows.sum(axis=0), "to_column": hidden.T @ columns, "column": column}


class Trainer:
    """Adam over batches of tokens."""

    def __init__(self, net: dict):
        self.net = {k: v.copy() for k, v in net.items()}
        self.mean = {k: np.zeros_like(v) for k, v in net.items()}
        self.square = {k: np.zeros_like(v) for k, v in net.items()}
        self.step = {k: np.zeros_like(v) for k, v in net.items()}
        self.steps = self.tokens = 0

    def learn(self, ids: np.ndarray, at: np.ndarray) -> None:
        for a in range(0, len(at), BATCH):
            part = at[a:a + BATCH]
            self.steps += 1
            self.tokens += len(part)
            scale = RATE * np.sqrt(1 - 0.999 ** self.steps) / (1 - 0.9 ** self.steps)
            for k, g in gradients(self.net, ids, part).items():
                mean, square, step = self.mean[k], self.square[k], self.step[k]
                mean *= 0.9
                mean += np.multiply(g, 0.1, out=step)
                square *= 0.999
                np.multiply(g, g, out=step)
                step *= 0.001
                square += step
                np.sqrt(square, out=step)
                step += 1e-8
                np.divide(mean, step, out=step)
                step *= scale
                self.net[k] -= step


def train(spark: SparkSession, cut: DataFrame, words: list[str], side: int) -> dict[str, np.ndarray]:
    """The average of the networks that the tasks trained on their shares of all documents."""
    shared = spark.sparkContext.broadcast((words, side))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, trainer = Tokens(*shared.value), Trainer(start(shared.value[1]))
        for batch in batches:
            for packed, distinct in zip(*batch.columns):
                of = tokens_of(distinct, tokens)
                places, bounds, _ = unpack(packed)
                for a in range(0, len(bounds) - 1, 500):
                    part = bounds[a:a + 501]
                    trainer.learn(*laid_out(of[places[part[0]:part[-1]]], np.diff(part), tokens.size))
        if trainer.tokens:
            flat = np.concatenate([v.ravel() for v in trainer.net.values()]).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * trainer.tokens),
                 pa.array(np.full(len(flat), trainer.tokens))], ["weight", "value", "tokens"])

    averaged = cut.select("packed", "words").mapInArrow(run, "weight int, value double, tokens long").groupBy(
        "weight").agg((F.sum("value") / F.sum("tokens")).alias("value"))
    net, at = start(side), 0
    found = {r["weight"]: r["value"] for r in averaged.collect()}  # one row per network weight
    for k, v in net.items():
        if found:
            net[k] = np.array([found[at + i] for i in range(v.size)], np.float32).reshape(v.shape)
        at += v.size
    return net


def score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, pseudo_log_likelihood, mean_log_prob``.

    Words are runs without white space, in lower case. A null, empty or blank text has no
    tokens, a likelihood of 0.0 and a null mean. Repeated rows score alike; other columns are
    not read. The network depends on how the input is split over tasks, so another layout of
    the same rows gives slightly other scores.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = blocks(spark, docs)
    counts = word_counts(spark, cut)
    side = side_of(counts.count())
    words = vocabulary(counts, side)
    shared = spark.sparkContext.broadcast((words, side, train(spark, cut, words, side)))
    held = cut.select("block", F.posexplode("words").alias("at", "word")).join(
        shares(spark, counts, words, side), "word").groupBy("block").agg(
        F.collect_list("at").alias("places"), F.collect_list("share").alias("shares"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the network says of each text, and the places of the rare words that are left to weigh."""
        words, side, net = shared.value
        tokens = Tokens(words, side)
        for batch in batches:
            for block, packed, distinct in zip(*batch.columns):
                of = tokens_of(distinct, tokens)
                places, bounds, doc_ids = unpack(packed)
                found = [np.zeros(0)]
                for a in range(0, len(doc_ids), 500):
                    part = bounds[a:a + 501]
                    ids, at = laid_out(of[places[part[0]:part[-1]]], np.diff(part), tokens.size)
                    found.append(sums(log_chances(net, ids, at), part - part[0]))
                rare = of[places] >= tokens.size - tokens.rare
                before = np.concatenate([[0], np.cumsum(rare)])[bounds]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.as_py()], pa.int64()),
                     pa.array([pack(places[rare], np.diff(before), ids=doc_ids, counts=pa.array(np.diff(bounds), pa.int64()),
                                    found=pa.array(np.concatenate(found)))])], ["block", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, rare_at, rare in zip(*batch.columns):
                places, bounds, doc_ids, counts, found = unpack(packed)
                share = np.zeros(places.max(initial=0) + 1)
                if rare_at.is_valid:
                    at, shares = rare_at.values.to_numpy(), rare.values.to_numpy()
                    met = at < len(share)
                    share[at[met]] = shares[met]
                total, n = found.to_numpy() + sums(share[places], bounds), counts.to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, counts, pa.array(total), pa.array(total / np.maximum(n, 1), mask=n == 0)],
                    ["doc_id", "n_tokens", "pseudo_log_likelihood", "mean_log_prob"])

    predicted = cut.select("block", "packed", "words").mapInArrow(predict, "block long, packed binary")
    return predicted.join(held, "block", "left").select("packed", "places", "shares").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, pseudo_log_likelihood double, mean_log_prob double")
