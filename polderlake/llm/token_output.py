"""Token ids in binary blocks, coded by an adaptive context-mixing range coder.

Documents are tokenized in id order into one stream of token ids for each range of documents,
and the stream is cut into blocks of a fixed number of ids. A block is coded on its own: its
model starts empty, and its header carries the CRC-32 of its ids. For each id, three orders
predict: the id that mostly followed the two ids before, the id that mostly followed the one
id before, and the adaptive counts of single ids. What hit or missed so far, kept by the
confidence of each order, is mixed by adding the counts and drives a range coder; an id that
no order foresaw is spelt from the order-0 counts.

The ids of a block lie in lanes that are coded side by side in numpy, one id of every lane at
a time, and share the block's model, which learns after each short run of steps. So the cost
is that of array operations. Blocks are rows of a Parquet table, which Spark's own committer
writes, so a lost executor never leaves half a file.

Texts are cut where the tokenizer always cuts, before white space, and the library encodes each
different piece once; ids of a text are gathered from those of its pieces.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polderlake.llm.common import power_of_two, shuffle_partitions

BLOCK = 1 << 20  # ids in a block
LANES = 4_096  # lanes of a block at most
LANE_IDS = 256  # ids in a lane at least, where a block has as many
RUN = 32  # steps after which a model learns; the first runs are shorter
MAGIC = b"CMB2"
HEADER = "<4sIIII"  # magic, ids, CRC-32 of the ids, lanes, largest id

_BITS = 18  # of the total that chances are shares of
_TOTAL = 1 << _BITS
_WORD, _BELOW = np.uint64(32), np.uint64(31)  # bits of a word, and of the low end below the next word
_LEAST, _MOST = np.uint64(1 << 31), np.uint64((1 << 63) - 1)  # of a range
_ALL = slice(None)
_SINGLES, _PAIRS = 1 << 16, 1 << 18  # slots
_LIMIT = 256  # of an order's counts when they are mixed


#: What a hit (the lowest bit) or a miss changes at a trust: it goes up to 7, or down.
_CHANGE = {one: np.array([-one if not at & 1 else one if at < 7 * one else 0 for at in range(7 * one + 2)])
           for one in (0x10, 2)}


class Counts:
    """Adaptive counts of symbols as shares of the total, at least one for each."""

    def __init__(self, symbols: int):
        self.count = np.zeros(symbols, np.int64)
        self.learn(np.zeros(0, np.int64))

    def learn(self, seen: np.ndarray) -> None:
        self.count += np.bincount(seen, minlength=len(self.count))
        weight = self.count * 32 + 1
        size = 1 + weight * (_TOTAL - len(weight)) // weight.sum()
        size[-1] += _TOTAL - size.sum()
        self.start, self.size = (np.cumsum(size) - size).astype(np.uint64), size.astype(np.uint64)

    def symbols(self) -> np.ndarray:
        """The symbol at each place of the total."""
        return np.repeat(np.arange(len(self.size), dtype=np.uint16), self.size.astype(np.int64))


class Model:
    """Predictions of orders 0 to 2 for the lanes of a block, starting empty."""

    def __init__(self, n: int, largest: int):
        # Ids + 1, and in the low seven bits the confidence, which is 0 in an empty slot: at bit 4
        # for pairs and at bit 1 for single ids, so that both make a context with bit 0 for equal ids.
        self.pair = np.zeros(min(_PAIRS, power_of_two(2 * n)), np.int64)
        self.single = np.zeros(_SINGLES, np.int64)
        # Chances of (order 2 is right, order 1 is right, neither) by what each order trusts, and
        # by both together.
        self.trust = [np.zeros((k, 3), np.int64) for k in (1, 16, 8)]
        self.both = np.ones((128, 3), np.int64)
        self.counts = [Counts(largest + 1)] if largest < 1 << 16 else [Counts(1 << 16), Counts(1 << 16)]
        self.mix()

    def look(self, a: np.ndarray, b: np.ndarray):
        """Slots and entries of both orders after the ids ``a, b``, and the context they make."""
        slot2 = (a * 0x9E3779B1 + b * 0x85EBCA77) >> 11 & len(self.pair) - 1
        slot1 = b & _SINGLES - 1
        second, first = self.pair.take(slot2), self.single.take(slot1)
        context = second & 0x70 | first & 0x0E | ((second ^ first) < 0x80)
        return slot2, slot1, second, first, context

    def mix(self) -> None:
        """Shares of the outcomes: three of each context, one after the other."""
        c = np.arange(128)
        mixed = 1 + self.both + sum(t[w] for t, w in zip(self.trust, (c * 0, c & 15, c >> 4)))
        mixed[c >> 4 == 0, 0] = 0
        mixed[(c >> 1 & 7 == 0) | (c & 1 == 1), 1] = 0
        size = mixed * (_TOTAL - 3) // mixed.sum(axis=1, keepdims=True) + (mixed > 0)
        size[:, 2] += _TOTAL - size.sum(axis=1)
        self.size = size.ravel().astype(np.uint64)
        self.start = (np.cumsum(size, axis=1) - size).ravel().astype(np.uint64)

    def learn(self, seen, slot2, slot1, second, first, context, outcome) -> None:
        """Take in a run of ids, in the order of steps: the last id of a slot counts."""
        named = seen + 1 << 7
        for table, slot, entry, one in ((self.pair, slot2, second, 0x10), (self.single, slot1, first, 2)):
            trust = entry & 7 * one
            right = (entry ^ named) < 0x80
            new = entry + _CHANGE[one].take(trust | right)
            weak = np.flatnonzero(~right & (trust <= one))
            new[weak] = named[weak] + one
            table[slot] = new
        by = np.bincount(context * 3 + outcome, minlength=384).reshape(128, 3)
        self.both += by
        by = by.reshape(8, 16, 3)
        for i, new in enumerate((by.sum(axis=(0, 1))[None], by.sum(axis=0), by.sum(axis=1))):
            new = self.trust[i] + new
            self.trust[i] = new // np.maximum(1, -(-new.sum(axis=1, keepdims=True) // _LIMIT))
        spelt = seen[outcome == 2]
        for k, counts in enumerate(reversed(self.counts)):
            counts.learn(spelt >> 16 * k & 0xFFFF)
        self.mix()


def _outcomes(seen, second, first) -> np.ndarray:
    """0 where order 2 is right, else 1 where order 1 is, else 2."""
    named = seen + 1 << 7
    wrong2 = (second ^ named) >= 0x80
    return wrong2 + (wrong2 & ((first ^ named) >= 0x80)).astype(np.int64)


class Encoder:
    """A range coder on every lane; a word goes out as soon as the range is below 31 bits.

    The top bit of the low end is a carry, which goes out with the next word and is added to
    the word before it in the end.
    """

    def __init__(self, lanes: int, symbols: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, _MOST)
        self.at = np.arange(lanes)  # place in the words, which lie in rows of one of each lane
        # A symbol costs little more than the bits of the total.
        self.words = np.zeros((symbols * (_BITS + 1) // 32 + 4, lanes), np.uint64)
        self.flat = self.words.ravel()

    def put(self, lanes, start: np.ndarray, size: np.ndarray) -> None:
        """Encode a share of the total on some lanes, or on all."""
        width = self.range[lanes]
        part = width >> np.uint64(_BITS)
        low, width = self.low[lanes] + start * part, part * size
        short = np.flatnonzero(width < _LEAST)
        if len(short):
            lane = short if lanes is _ALL else lanes[short]
            at, out = self.at[lane], low[short]
            self.flat[at] = out >> _BELOW
            self.at[lane] = at + len(self.at)
            low[short] = (out & (_LEAST - np.uint64(1))) << _WORD
            width[short] <<= _WORD
        self.low[lanes], self.range[lanes] = low, width

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """How many words each lane has, and the words of all lanes."""
        # The next word, rounded up; what follows counts as zeros and is not written.
        self.flat[self.at] = (self.low + (_LEAST - np.uint64(1))) >> _BELOW
        for k in range(len(self.words) - 1, 0, -1):
            self.words[k - 1] += self.words[k] >> _WORD
        lengths = self.at // len(self.at) + 1
        held = np.arange(len(self.words)) < lengths[:, None]
        return lengths.astype("<u4"), self.words.astype("<u4").T[held]


class Decoder:
    """The other way; what is kept is how far the code lies above the low end of the range."""

    def __init__(self, lengths: np.ndarray, words: np.ndarray, symbols: int):
        # Every lane ends with a zero; a damaged one may be read beyond its end.
        ends = np.cumsum(lengths + 1)
        laid = np.zeros(ends[-1] + symbols + 3, np.uint64)
        laid[np.arange(len(words)) + np.repeat(np.arange(len(lengths)), lengths)] = words
        # Words as they are shifted in: the last bit of one and all but the last of the next.
        self.flat = (laid[:-1] & np.uint64(1)) << _BELOW | laid[1:] >> np.uint64(1)
        self.range, self.at = np.full(len(lengths), _MOST), ends - lengths
        first = ends - lengths - 1
        self.above = laid[first] << _BELOW | laid[first + 1] >> np.uint64(1)

    def look(self, lanes) -> tuple[np.ndarray, np.ndarray]:
        """What one of the total is worth, and the place in the total."""
        part = self.range[lanes] >> np.uint64(_BITS)
        return part, np.minimum(self.above[lanes] // part, np.uint64(_TOTAL - 1))

    def take(self, lanes, part, start: np.ndarray, size: np.ndarray) -> None:
        above, width = self.above[lanes] - start * part, part * size
        short = np.flatnonzero(width < _LEAST)
        if len(short):
            lane = short if lanes is _ALL else lanes[short]
            at = self.at[lane]
            above[short] = above[short] << _WORD | self.flat[at]
            self.at[lane] = at + 1
            width[short] <<= _WORD
        self.above[lanes], self.range[lanes] = above, width


def _runs(steps: int) -> Iterator[tuple[int, int]]:
    at, n = 0, 1
    while at < steps:
        yield at, min(at + n, steps)
        at, n = at + n, min(2 * n, RUN)


def _encode(coder: Encoder, model: Model, ids: np.ndarray) -> None:
    """Code ``ids[step + 2, lane]``, of which the first two rows are zeros."""
    for begin, end in _runs(len(ids) - 2):
        seen = ids[begin + 2:end + 2]
        looked = model.look(ids[begin:end], ids[begin + 1:end + 1])
        outcome = _outcomes(seen, *looked[2:4])
        which = looked[4] * 3 + outcome
        start, size, missed = model.start.take(which), model.size.take(which), outcome == 2
        for step in range(end - begin):
            coder.put(_ALL, start[step], size[step])
            spell = np.flatnonzero(missed[step])
            if len(spell):
                word = seen[step].take(spell)
                for k, counts in enumerate(model.counts, 1 - len(model.counts)):
                    digit = word >> -16 * k & 0xFFFF
                    coder.put(spell, counts.start.take(digit), counts.size.take(digit))
        model.learn(*[x.ravel() for x in (seen, *looked, outcome)])


def _decode(coder: Decoder, model: Model, ids: np.ndarray) -> None:
    """Fill ``ids[step + 2, lane]``."""
    for begin, end in _runs(len(ids) - 2):
        symbols = [counts.symbols() for counts in model.counts]
        start1, start2 = model.start[1::3].copy(), model.start[2::3].copy()
        for step in range(begin, end):
            _, _, second, first, context = model.look(ids[step], ids[step + 1])
            part, place = coder.look(_ALL)
            wrong2, missed = place >= start1.take(context), place >= start2.take(context)
            which = context * 3 + wrong2 + missed
            coder.take(_ALL, part, model.start.take(which), model.size.take(which))
            seen = (np.where(wrong2, first, second) >> 7) - 1
            spell = np.flatnonzero(missed)
            if len(spell):
                word = 0
                for counts, symbol in zip(model.counts, symbols):
                    part, place = coder.look(spell)
                    digit = symbol.take(place.astype(np.int64)).astype(np.int64)
                    coder.take(spell, part, counts.start.take(digit), counts.size.take(digit))
                    word = word << 16 | digit
                seen[spell] = word
            ids[step + 2] = seen
        seen = ids[begin + 2:end + 2]
        looked = model.look(ids[begin:end], ids[begin + 1:end + 1])
        model.learn(*[x.ravel() for x in (seen, *looked, _outcomes(seen, *looked[2:4]))])


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encode_block(ids: np.ndarray, lanes: int = LANES) -> bytes:
    """A block of ids (unsigned, at most 32 bits) as bytes."""
    largest = int(ids.max(initial=0))
    steps = -(-len(ids) // max(1, min(lanes, len(ids) // LANE_IDS)))
    lanes = -(-len(ids) // max(1, steps))
    head = struct.pack(HEADER, MAGIC, len(ids), _crc(ids), lanes, largest)
    if not len(ids):
        return head
    rows = np.zeros((steps + 2, lanes), np.int64)
    padded = np.zeros(steps * lanes, np.int64)
    padded[:len(ids)] = ids
    rows[2:] = padded.reshape(lanes, steps).T
    model = Model(len(ids), largest)
    coder = Encoder(lanes, steps * (1 + len(model.counts)))
    _encode(coder, model, rows)
    lengths, words = coder.finish()
    return head + lengths.tobytes() + words.tobytes()


def decode_block(payload: bytes) -> np.ndarray:
    """The ids of a block; one that is damaged raises."""
    magic, n, crc, lanes, largest = struct.unpack_from(HEADER, payload)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    body = np.frombuffer(payload[struct.calcsize(HEADER):len(payload) & ~3], "<u4")
    lengths = body[:lanes].astype(np.int64)
    if lanes > n or lengths.sum() != len(body) - lanes or (n > 0) != (lanes > 0):
        raise ValueError("a block of token ids fails its checksum")
    ids = np.zeros(0, np.int64)
    if n:
        model, steps = Model(n, largest), -(-n // lanes)
        rows = np.zeros((steps + 2, lanes), np.int64)
        _decode(Decoder(lengths, body[lanes:], steps * (1 + len(model.counts))), model, rows)
        ids = rows[2:].T.ravel()[:n]
    if _crc(ids) != crc:
        raise ValueError("a block of token ids fails its checksum")
    return ids


def encode_blocks(blocks: list[np.ndarray], lanes: int = LANES) -> list[bytes]:
    """Each block of ids as bytes."""
    return [encode_block(ids, lanes) for ids in blocks]


def decode_blocks(payloads: list[bytes]) -> list[np.ndarray]:
    """The ids of each block."""
    return [decode_block(p) for p in payloads]


GROUP_BYTES = 24 << 20  # of texts whose pieces are told apart at a time, but for a longer text
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SOLID = np.arange(256) > 32
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_MARK = _SOLID & np.array([b < 127 and not chr(b).isalnum() for b in range(256)])
#: Second bytes of the letters U+00C0 to U+00FF, without the signs of times and division.
_AFTER_C3 = np.isin(np.arange(256), [b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)])


def cuts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in UTF-8 bytes before which the tokenizer always cuts.

    First those at white space after none: only an ASCII blank counts, and only after a character
    that is surely no white space, so that a run of white space lies in one piece. Then those at
    an ASCII mark after a letter of Latin-1.
    """
    at = np.flatnonzero(_BLANK[data[1:]] & _SOLID[data[:-1]]) + 1
    wide = at[data[at - 1] >= 0x80]
    # U+0085, U+00A0; then more than the spaces of three bytes, U+1680 to U+3000.
    b1, b2, b3 = (data[np.maximum(wide - k, 0)] for k in (1, 2, 3))
    blank = (b2 == 0xC2) & np.isin(b1, (0x85, 0xA0)) | np.isin(b3, (0xE1, 0xE2, 0xE3)) & np.isin(
        b2, (0x80, 0x81, 0x9A, 0xA0))
    at = np.setdiff1d(at, wide[blank], assume_unique=True) if blank.any() else at
    mark = np.flatnonzero(_MARK[data[1:]]) + 1
    last = data[mark - 1]
    return at, mark[_LETTER[last] | _AFTER_C3[last] & (data[np.maximum(mark - 2, 0)] == 0xC3)]


@lru_cache(maxsize=2)
def _tokenizers(definition: str):
    """The tokenizer; the same for words in lines; letters that stand for bytes; the bytes of each
    token; whether the tokenizer splits texts as is known here; and the tokens that it looks for first."""
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer, words = Tokenizer.from_str(definition), Tokenizer.from_str(definition)
    words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
    whole = json.loads(definition)
    split = whole["pre_tokenizer"] or {}
    known = (split.get("type"), split.get("use_regex"), split.get("add_prefix_space"), whole["normalizer"],
             whole["post_processor"]) == ("ByteLevel", True, False, None, None)
    added = whole["added_tokens"]
    known = known and not any(t[k] for t in added for k in ("lstrip", "rstrip", "single_word", "normalized"))
    bytes_ = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    spelt = lambda c: bytes_.pre_tokenize_str(c)[0][0]
    letters = {b: spelt(chr(b)) for b in range(128)} | {10: "\n"}
    letters |= {b: spelt(chr(b + 0x40))[1] for b in range(0x80, 0xC0)} | {0xC3: spelt("\xe9")[0]}
    vocabulary = tokenizer.get_vocab()
    spans = np.zeros(max(vocabulary.values()) + 1, np.int64)
    spans[list(vocabulary.values())] = [len(t) for t in vocabulary]
    table = np.zeros(256, "<u4")
    table[list(letters)] = [ord(c) for c in letters.values()]
    return tokenizer, words, table, spans, known, [t["content"].encode() for t in added]


class Pieces:
    """Ids of texts from those of their pieces, of which the library encodes each different one
    of a group of texts once.

    A word of letters of Latin-1, after a blank or not, is one word to the tokenizer's own
    splitter: many are handed over at a time, already split. Other pieces are encoded as texts.
    """

    def __init__(self, definition: str, end_id: int):
        self.end_id = end_id
        self.tokenizer, self.words, self.letters, self.spans, self.known, self.added = _tokenizers(definition)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text (``large_binary``, no nulls), with the end id."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + GROUP_BYTES, "right")) - 1)
            yield from self._group(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            a = b

    def _group(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        begins = np.zeros(len(data) + 1, bool)
        if self.known:
            for at in cuts(data):
                begins[at] = True
            whole = data.tobytes()
            for token in self.added:
                at = whole.find(token)
                while at >= 0:
                    begins[at + 1:at + len(token)] = False
                    at = whole.find(token, at + 1)
        begins[offsets] = True
        begins[-1] = False
        starts = np.flatnonzero(begins)
        cut = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))),
                                             pa.py_buffer(data)]).dictionary_encode()
        number = cut.indices.to_numpy()
        ids, sizes = self._pieces(cut.dictionary)
        first = np.cumsum(sizes) - sizes
        ends = np.searchsorted(starts, offsets)  # pieces before each text
        for a in range(0, len(ends) - 1, 500):
            upto = ends[a:a + 501]
            some = np.insert(number[upto[0]:upto[-1]], upto[1:] - upto[0], len(sizes) - 1)
            size = sizes[some]
            end = np.cumsum(size)
            at = np.repeat(first[some] - (end - size), size)
            at += np.arange(len(at))
            yield from np.split(ids[at], end[upto[1:] - upto[0] + np.arange(len(upto) - 1)][:-1])

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, the end of a text last, and how many each has."""
        bounds = np.frombuffer(pieces.buffers()[1], np.int64)[:len(pieces) + 1]
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[:bounds[-1]]
        latin = np.zeros(len(data), bool)
        if len(data) > 1:
            latin[1:] = (data[:-1] == 0xC3) & _AFTER_C3[data[1:]]
            latin[:-1] |= latin[1:]
        other = ~(_LETTER[data] | latin)
        other[bounds[:-1][data[bounds[:-1]] == 32]] = False  # a blank may lead
        count = np.append(0, np.cumsum(other))
        # A blank alone is a piece that is encoded as a text.
        plain = (count[bounds[1:]] == count[bounds[:-1]]) & ((np.diff(bounds) > 1) | (data[bounds[:-1]] != 32))
        plain &= self.known
        sizes = np.zeros(len(pieces) + 1, np.int64)
        sizes[-1] = 1
        texts = [t.decode() for t in pieces.filter(pa.array(~plain)).to_pylist()]
        coded = [e.ids for a in range(0, len(texts), 10_000) for e in self.tokenizer.encode_batch_fast(
            texts[a:a + 10_000], add_special_tokens=False)]
        sizes[:-1][~plain] = np.fromiter(map(len, coded), np.int64, len(coded))
        of_texts = np.fromiter(chain.from_iterable(coded), np.int64)
        of_words, of_word_sizes = self._words(pieces.filter(pa.array(plain)))
        sizes[:-1][plain] = of_word_sizes
        of = np.repeat(np.append(plain, False), sizes)
        ids = np.full(len(of), self.end_id, np.int64)
        ids[of] = of_words
        of[-1] = True
        ids[~of] = of_texts
        return ids, sizes

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, encoded by lines, and how many each has by the bytes that they span."""
        bounds = np.frombuffer(words.buffers()[1], np.int64)[:len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[:bounds[-1]]
        lines = self.letters[np.insert(data, bounds[1:], 10)]
        ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(words), 100_000):
            ends = bounds[a:a + 100_001]
            # Places in the lines, each of which ends with a byte of its own.
            at = [*(ends + a + np.arange(len(ends)))[:-1:1_000], ends[-1] + a + len(ends) - 1]
            coded = self.words.encode_batch_fast([lines[b:c].tobytes().decode("utf-32-le") for b, c in zip(at, at[1:])],
                                                 add_special_tokens=False)
            ids.append(np.concatenate([np.array(e.ids, np.int64) for e in coded]))
            upto = np.searchsorted(np.cumsum(self.spans[ids[-1]]), ends[1:] - ends[0]) + 1
            sizes.append(np.diff(upto, prepend=0))
        return np.concatenate(ids), np.concatenate(sizes)


BLOCKS = ("part long, block long, at long, n_ids long, rows array<long>, doc_ids array<{kind}>, "
          "counts array<long>, firsts array<boolean>, lasts array<boolean>, payload binary")


def write_tokens(docs: DataFrame, path: str, tokenizer_json: str, end_id: int = 0,
                 block: int = BLOCK, lanes: int = LANES) -> None:
    """Write the ids of all documents in ascending ``doc_id`` as a table of coded blocks.

    Ranges of ids are files; a range is one task, which tokenizes some texts and codes the full
    blocks they make at a time. A block has ``lanes`` lanes at most, and lists the documents in
    it and how many ids of each it holds. A null text is an empty one.
    """
    parts = shuffle_partitions(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    definition = docs.sparkSession.sparkContext.broadcast(open(tokenizer_json, encoding="utf-8").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        pieces = Pieces(definition.value, end_id)
        part, number, row, at = TaskContext.get().partitionId(), 0, 0, 0
        waiting: list[tuple[int, object, np.ndarray]] = []  # row, doc_id and ids, not yet coded
        held = begun = 0  # ids waiting; ids of the first of them that earlier blocks hold

        def flush(everything: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, held, begun, number, at
            if not held:
                return
            stream = np.concatenate([w[2] for w in waiting])
            whole = len(stream) if everything else len(stream) // block * block
            edges = list(range(0, whole, block)) + [whole]
            ends = np.cumsum([len(w[2]) for w in waiting])
            starts = ends - [len(w[2]) for w in waiting]
            columns: dict[str, list] = {c.split()[0]: [] for c in BLOCKS.split(", ")}
            blocks = [stream[a:b] for a, b in zip(edges, edges[1:])]
            for a, b, payload in zip(edges, edges[1:], encode_blocks(blocks, lanes)):
                lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
                inside = range(int(lo), int(hi))
                for name, value in (
                        ("part", part), ("block", number), ("at", at + a), ("n_ids", b - a),
                        ("rows", [waiting[i][0] for i in inside]),
                        ("doc_ids", [waiting[i][1] for i in inside]),
                        ("counts", [int(min(b, ends[i]) - max(a, starts[i])) for i in inside]),
                        ("firsts", [bool(starts[i] >= a and not (i == 0 and begun)) for i in inside]),
                        ("lasts", [bool(ends[i] <= b) for i in inside]), ("payload", payload)):
                    columns[name].append(value)
                number += 1
            left = int(np.searchsorted(ends, whole, "right"))
            rest = stream[whole:]
            begun = 0
            if len(rest):
                begun = int(whole > starts[left]) or int(left == 0 and begun)
                keep = [(waiting[left][0], waiting[left][1], stream[max(whole, starts[left]):ends[left]])]
                waiting = keep + waiting[left + 1:]
            else:
                waiting = []
            at += whole
            held = len(rest)
            yield pa.RecordBatch.from_pydict(columns, schema)

        schema = None
        for batch in batches:
            schema = schema or pa.schema([
                ("part", pa.int64()), ("block", pa.int64()), ("at", pa.int64()), ("n_ids", pa.int64()),
                ("rows", pa.list_(pa.int64())), ("doc_ids", pa.list_(batch.schema.field(0).type)),
                ("counts", pa.list_(pa.int64())), ("firsts", pa.list_(pa.bool_())),
                ("lasts", pa.list_(pa.bool_())), ("payload", pa.binary())])
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            for doc_id, ids in zip(batch.column(0).to_pylist(), pieces.encode(texts)):
                waiting.append((row, doc_id, ids))
                held += len(ids)
                row += 1
                if held >= 4 * block:
                    yield from flush(False)
        yield from flush(True)

    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, BLOCKS.format(kind=kind)).write.option("compression", "none").parquet(path)


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC-32 polynomial, bits reversed as in the CRC."""
    product, bit = 0, 1 << 31
    while bit:
        if a & bit:
            product ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        bit >>= 1
    return product


def crc_of_both(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings put together, from theirs and the second one's length."""
    power, factor = 1 << 31, 1 << 23  # x**0 and x**8
    while length:
        if length & 1:
            power = _times(power, factor)
        factor = _times(factor, factor)
        length >>= 1
    return _times(first, power) ^ second


def read_tokens(spark: SparkSession, path: str, lanes: int = 1) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it. A task decodes ``lanes`` blocks and then
    passes on what it found of their documents. A document that spans blocks is put
    together from the checksums of its pieces, so its ids are never gathered.
    """
    blocks = spark.read.parquet(path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, lanes):
                batch = whole.slice(a, lanes)
                rows = batch.to_pydict()
                out: list[list] = [[] for _ in range(8)]
                for i, ids in enumerate(decode_blocks(rows["payload"])):
                    begin = 0
                    words = ids.astype("<u4").tobytes()
                    for row, doc_id, n, first, last in zip(*(rows[c][i] for c in (
                            "rows", "doc_ids", "counts", "firsts", "lasts"))):
                        for column, value in zip(out, (
                                rows["part"][i], row, doc_id, rows["at"][i] + begin, n,
                                zlib.crc32(words[4 * begin:4 * (begin + n)]), first, last)):
                            column.append(value)
                        begin += n
                kinds = [pa.int64(), pa.int64(), batch.schema.field("doc_ids").type.value_type,
                         *[pa.int64()] * 3, pa.bool_(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, kinds)],
                    ["part", "row", "doc_id", "at", "n", "crc", "first", "last"])

    pieces = blocks.drop("block", "n_ids").mapInArrow(
        run, f"part long, row long, doc_id {kind}, at long, n long, crc long, first boolean, last boolean")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs, sizes = [], []
            for some in batch.column(2).to_pylist():
                crc = size = 0
                for piece in sorted(some, key=lambda p: p["at"]):
                    crc = crc_of_both(crc, piece["crc"], 4 * piece["n"]) if size else piece["crc"]
                    size += piece["n"]
                crcs.append(crc)
                sizes.append(size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(sizes, pa.int64()),
                 pa.array(crcs, pa.int64())], ["part", "doc_id", "at", "n", "crc"])

    grouped = pieces.groupBy("part", "row").agg(
        F.any_value("doc_id").alias("doc_id"), F.collect_list(F.struct("at", "n", "crc")).alias("some"),
        F.min("at").alias("at"))
    docs = grouped.select("part", "doc_id", "some", "at").mapInArrow(
        join, f"part long, doc_id {kind}, at long, n long, crc long")
    # One total for each range of documents, as many as there are files.
    totals = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    base, bases = 0, []
    for part in sorted(totals):
        bases.append((part, base))
        base += totals[part]
    known = spark.createDataFrame(bases, "part long, base long")
    return docs.join(F.broadcast(known), "part").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"),
        F.col("crc").alias("ids_crc32"))
