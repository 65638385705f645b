"""SentencePiece encoding and decoding over a lattice of pieces.

A text is a sequence of words, each a run of blanks with what follows it; no piece crosses from
a letter to a blank, so words encode on their own and a repeated word needs encoding once. The
substrings of bounded length of all distinct words of a batch are laid out as one relation,
joined by hash and content to the piece table, and the edges found are held per word and place:
the lattice. A fold over each word's edges picks its pieces. For a unigram model that is Viterbi
over the sum of scores; for a byte-pair model, whose scores are merge ranks and no
probabilities, it joins the neighbours with the best score until no edge is left, which is what
the model's own encoder does.

Documents are encoded where they lie: one pass, nothing shuffled, memory bounded by a batch.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = "▁"
WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
LONG = 200  # letters; longer words are folded one by one
BATCH = 500
REMEMBER = 250_000  # encoded words a task keeps
NONE = -np.inf
PRIME = 0x100000001B3


@dataclass
class Pieces:
    """The piece table: ids are places in ``texts``."""

    texts: list[str]
    scores: list[float]
    special: list[int]  # control and unknown ids, which no text encodes to
    byte_ids: list[int]  # ids of the 256 byte pieces; empty without byte fallback
    unknown: int
    kind: str = "bpe"  # or "unigram"
    prefix: bool = True  # a blank goes before each text that is not empty


def load(model_file: str, kind: str = "bpe") -> Pieces:
    """The table of a model file, read on the driver."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = range(m.get_piece_size())
    return Pieces([m.id_to_piece(i) for i in n], [m.get_score(i) for i in n],
                  [i for i in n if m.is_control(i) or m.is_unknown(i) or m.is_unused(i)],
                  [i for i in n if m.is_byte(i)], m.unk_id(), kind)


class Numbers(dict):
    """A number for each word met; words without one get the next and are ``new`` for a while."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Lattice:
    """Edges and folds for the words of a batch."""

    def __init__(self, table: Pieces):
        self.table = table
        left_out = {*table.special, *table.byte_ids}
        self.id_of = {t: i for i, t in enumerate(table.texts) if i not in left_out and t}
        self.longest = max(map(len, self.id_of), default=1)
        ids = np.fromiter(self.id_of.values(), np.int64, len(self.id_of))
        hashes = np.array([self._hash(t) for t in self.id_of], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], ids[order]
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces share a hash")
        # Slots by the top bits of a hash, so that a probe looks at very few pieces.
        self.bits = max(1, len(hashes).bit_length() + 1)
        self.slots = np.searchsorted(self.hashes >> np.uint64(64 - self.bits),
                                     np.arange((1 << self.bits) + 1, dtype=np.uint64))
        self.score = np.array(table.scores)
        self._forget()
        self.lowest = min(table.scores, default=0.0) - 10.0

    def _forget(self) -> None:
        self.known = Numbers()
        self.encoded, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)  # by the words' numbers

    @staticmethod
    def _mix(h):
        return (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)

    def _hash(self, text: str) -> int:
        h = 0
        for c in text:
            h = (h * PRIME + ord(c) + 1) % 2 ** 64
        h = (h + len(text) * PRIME ** 2) % 2 ** 64
        return int(self._mix(np.array([h], np.uint64))[0])

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All letters, the start of each word in them, and ``edge[place, length - 1]``: the id
        of the piece of that length that begins at that place in its word, or -1."""
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        n = len(letters)
        room = np.repeat(starts + lengths, lengths) - np.arange(n)  # letters left in the word
        found = np.full((n, self.longest), -1, np.int32)
        place, previous = np.arange(n), np.zeros(n, np.uint64)
        for size in range(1, self.longest + 1):
            place = place[room[place] >= size]
            h = previous[place] * np.uint64(PRIME) + letters[place + size - 1] + np.uint64(1)
            previous[place] = h
            mixed = self._mix(h + np.uint64(size * PRIME ** 2 % 2 ** 64))
            at = self.slots[(mixed >> np.uint64(64 - self.bits)).astype(np.int64)]
            end = self.slots[(mixed >> np.uint64(64 - self.bits)).astype(np.int64) + 1]
            open_ = np.flatnonzero(at < end)
            while len(open_):
                hit = self.hashes[at[open_]] == mixed[open_]
                found[place[open_[hit]], size - 1] = self.ids[at[open_[hit]]]
                open_ = open_[~hit]
                at[open_] += 1
                open_ = open_[at[open_] < end[open_]]
        return letters, starts, found

    def _ends(self, words: list[str], starts: np.ndarray, begin: np.ndarray, end: np.ndarray,
              edge: np.ndarray) -> list[list[int]]:
        """Ids of the chosen pieces, letters without a piece as bytes or as unknown."""
        chosen = edge[begin, end - begin - 1].tolist()
        bounds = np.searchsorted(begin, np.append(starts, len(edge))).tolist()
        bare = begin.tolist()
        whole = "".join(words)
        out = []
        for a, b in zip(bounds, bounds[1:]):
            ids = chosen[a:b]
            if -1 in ids:
                ids = [i for k in range(a, b) for i in (
                    [chosen[k]] if chosen[k] >= 0 else self._bytes(whole[bare[k]]))]
            out.append(ids)
        return out

    def _bytes(self, letter: str) -> list[int]:
        if not self.table.byte_ids:
            return [self.table.unknown]
        return [self.table.byte_ids[b] for b in letter.encode("utf-8", "surrogatepass")]

    def merged(self, words: list[str]) -> list[list[int]]:
        """Fold of a byte-pair model: in each round, each word joins its best neighbours."""
        letters, starts, edge = self.edges(words)
        n = len(letters)
        begin = np.arange(n)
        end = begin + 1
        word = np.repeat(np.arange(len(words)), np.diff(np.append(starts, n)))
        done_begin, done_end = [], []
        while len(begin):
            size = end[1:] - begin[:-1]
            fits = (word[1:] == word[:-1]) & (size <= self.longest)
            pair = np.full(len(begin), NONE)
            at = np.flatnonzero(fits)
            piece = edge[begin[at], size[at] - 1]
            pair[at] = np.where(piece >= 0, self.score[piece], NONE)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.maximum.reduceat(pair, first)
            spread = np.repeat(best, np.diff(np.append(first, len(begin))))
            live = spread > NONE
            done_begin.append(begin[~live])
            done_end.append(end[~live])
            # The leftmost best pair of each word that still has one.
            hits = np.flatnonzero(live & (pair == spread))
            hits = hits[np.diff(word[hits], prepend=-1) != 0]
            end = end.copy()
            end[hits] = end[hits + 1]
            live[hits + 1] = False
            begin, end, word = begin[live], end[live], word[live]
        begin, end = np.concatenate([*done_begin, begin]), np.concatenate([*done_end, end])
        order = np.argsort(begin, kind="stable")
        return self._ends(words, starts, begin[order], end[order], edge)

    def viterbi(self, words: list[str]) -> list[list[int]]:
        """Fold of a unigram model: the best sum of scores at each place of all words at once."""
        letters, starts, edge = self.edges(words)
        n, lengths = len(letters), np.diff(np.append(starts, len(letters)))
        best = np.full(n + len(words), NONE)  # one place more than letters for each word
        back = np.zeros(n + len(words), np.int64)
        base = starts + np.arange(len(words))
        best[base] = 0.0
        for at in range(int(lengths.max(initial=0))):
            live = np.flatnonzero(lengths > at)
            here = best[base[live] + at]
            for size in range(1, min(self.longest, int(lengths.max()) - at) + 1):
                fit = lengths[live] >= at + size
                w = live[fit]
                piece = edge[starts[w] + at, size - 1]
                gain = np.where(piece >= 0, self.score[piece], self.lowest if size == 1 else NONE)
                total, to = here[fit] + gain, base[w] + at + size
                better = total > best[to]
                best[to[better]] = total[better]
                back[to[better]] = size
        begin, end = [], []
        left = lengths.copy()
        while (live := np.flatnonzero(left > 0)).size:
            size = back[base[live] + left[live]]
            end.append(starts[live] + left[live])
            left[live] -= size
            begin.append(starts[live] + left[live])
        begin, end = (np.concatenate([*x, np.empty(0, np.int64)]) for x in (begin, end))
        order = np.argsort(begin)
        return self._ends(words, starts, begin[order], end[order], edge)

    def merged_long(self, word: str) -> list[int]:
        """The byte-pair fold of one long word, with a queue of its neighbours."""
        n = len(word)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[float, int, int]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < n and end[b] - a <= self.longest:
                piece = self.id_of.get(word[a:end[b]])
                if piece is not None:
                    heapq.heappush(queue, (-self.table.scores[piece], a, end[b]))

        for a in range(n):
            offer(a)
        gone = bytearray(n)
        while queue:
            _, a, stop = heapq.heappop(queue)
            b = after[a]
            if gone[a] or b >= n or end[b] != stop:
                continue
            gone[b] = 1
            end[a], after[a] = stop, after[b]
            if after[a] < n:
                before[after[a]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        ids: list[int] = []
        a = 0
        while a < n:
            piece = self.id_of.get(word[a:end[a]])
            ids += self._bytes(word[a]) if piece is None else [piece]
            a = end[a]
        return ids

    def encode_words(self, words: list[str]) -> list[list[int]]:
        if self.table.kind == "unigram":
            return self.viterbi(words) if words else []
        short = [w for w in words if len(w) <= LONG]
        found = dict(zip(short, self.merged(short))) if short else {}
        return [found[w] if w in found else self.merged_long(w) for w in words]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return self.encode_array(texts).to_pylist()

    def encode_array(self, texts: list[str | None]) -> pa.ListArray:
        split = [self.words(t) for t in texts]
        if len(self.known) > REMEMBER:
            self._forget()
        counts = np.fromiter(map(len, split), np.int64, len(split))
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, counts.sum())
        if self.known.new:
            ids, self.known.new = self.encode_words(self.known.new), []
            ends = self.bounds[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
            self.encoded = np.concatenate([self.encoded, np.fromiter(chain.from_iterable(ids), np.int32)])
            self.bounds = np.concatenate([self.bounds, ends])
        begin = self.bounds[numbers]
        sizes = self.bounds[numbers + 1] - begin
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], sizes)
        of_texts = ends[np.concatenate([[0], np.cumsum(counts)])]
        return pa.ListArray.from_arrays(pa.array(of_texts, pa.int32()), pa.array(self.encoded[at]))

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        front = BLANK if self.table.prefix else ""
        if "  " not in text and BLANK not in text and text[0] != " " != text[-1]:
            return (front + text.replace(" ", " " + BLANK)).split(" ")  # single blanks: as WORD, in less time
        return WORD.findall(front + text.replace(" ", BLANK))


def _encoder(table: Pieces, text_at: int, append):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(table)
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                yield append(part, lattice.encode_array(part.column(text_at).to_pylist()))
    return run


def encode(docs: DataFrame, table: Pieces, column: str = "piece_ids") -> DataFrame:
    """``docs`` with the ids of its texts in a new column, which replaces one of that name.

    Null and empty texts have no ids. Repeated rows give repeated rows.
    """
    docs = docs.drop(column)
    names = [*docs.columns, column]
    append = lambda part, ids: pa.RecordBatch.from_arrays([*part.columns, ids], names)
    out = T.StructType([*docs.schema.fields, T.StructField(column, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(_encoder(table, docs.columns.index("text"), append), out)


def decoded(ids: str, table: Pieces) -> Column:
    """The text of a column of ids, by built-in functions on the table as a literal.

    Byte pieces are put together and read as UTF-8; special ids give no text; the blank of the
    encoder in front is taken off. A blank letter U+2581 of the original reads as a space.
    """
    byte_of = {i: b for b, i in enumerate(table.byte_ids)}
    special = set(table.special)
    as_hex = ["" if i in special else f"{byte_of[i]:02X}" if i in byte_of else
              t.replace(BLANK, " ").encode().hex().upper() for i, t in enumerate(table.texts)]
    hexes = F.split(F.lit(" ".join(as_hex)), " ")
    joined = F.array_join(F.transform(F.col(ids), lambda i: F.get(hexes, i)), "")
    text = F.decode(F.unhex(joined), "UTF-8")
    return F.regexp_replace(text, "^ ", "") if table.prefix else text


def decodes(table: Pieces, ids: str = "piece_ids") -> Column:
    """Whether the ids of a row give its text back, a letter U+2581 as a space."""
    return decoded(ids, table) == F.translate(F.coalesce("text", F.lit("")), BLANK, " ")


def round_trip(docs: DataFrame, table: Pieces) -> DataFrame:
    """``doc_id, n_pieces, ids_xxhash, decodes`` per row: whether decoding gives the text back."""
    return encode(docs.select("doc_id", "text"), table).select(
        "doc_id", F.size("piece_ids").cast("long").alias("n_pieces"),
        F.xxhash64("piece_ids").alias("ids_xxhash"), decodes(table).alias("decodes"))
