import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from fixtures import ODD, odd_documents, plain
from tokenizers import Tokenizer, pre_tokenizers

from polderlake.llm import token_output as to
from polderlake.session import scratch_path

FILE = public_tokenizers.path("byte_bpe_50k.json")


def test_blocks_round_trip_on_their_own():
    r = np.random.default_rng(0)
    blocks = [r.integers(0, 50_257, n) for n in (1, 2, 100, 700, 37)]
    blocks += [np.zeros(500, np.int64), np.tile([5, 6, 7, 9], 300), np.array([2**32 - 1, 0, 7]), r.zipf(1.3, 900) % 50_257]
    coded = to.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, to.decode_blocks(coded)))
    assert (to.decode_blocks(coded[3:4])[0] == blocks[3]).all()  # alone as among others
    assert len(coded[6]) < 100  # a repeating block is foreseen
    assert to.encode_blocks([]) == [] and to.decode_blocks([]) == []


def test_damage_is_noticed():
    block = bytearray(to.encode_blocks([np.arange(300)])[0])
    block[80] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        to.decode_blocks([bytes(block)])
    with pytest.raises(ValueError, match="not a block"):
        to.decode_blocks([b"x" * 40])


def test_checksum_of_two_pieces():
    a, b = b"some bytes", b"and many more of them" * 9
    assert to.crc_of_both(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("block, lanes", [(16, 3), (4_096, 1_024)])
def test_documents_from_the_files(spark, block, lanes):
    rows = [(i, t[:3_000] if t else t) for i, t, _ in ODD] + [(20 + i, f"text {i} " * i) for i in range(30)]
    path = scratch_path(spark, "tokens")
    to.write_tokens(plain(spark, rows), path, FILE, block=block, lanes=lanes)
    got = sorted(to.read_tokens(spark, path, lanes=lanes).collect(), key=lambda r: r.start)
    tokenizer, at = Tokenizer.from_file(FILE), 0

    def digest(text):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        return len(ids), zlib.crc32(ids.tobytes())

    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(
        (i, *digest(t)) for i, t in rows)
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids) and got[0].doc_id is None


def test_odd_rows_and_empty_table(spark):
    docs = odd_documents(spark)
    for df, n in ((docs, len(ODD)), (docs.limit(0), 0)):
        path = scratch_path(spark, "tokens")
        to.write_tokens(df, path, FILE)
        assert to.read_tokens(spark, path).count() == n


def test_pieces_give_the_ids_of_the_whole_text():
    r = np.random.default_rng(5)
    bits = ["a", "Zé", "ß", "×", "÷", "Ø", "don't", "'s", "'", "’ll", " ", "  ", "\n", "\r\n", "\t", "\x0b", " ", "\u0085",
            " ", "　", " ", "​", "᠎", " ", "\x00", "\x1c", "\x7f", "1", "½", "²", "42", ".", ",", "!?", "_", "é", "ª", "ñandú",
            "日本", "😀", "é", "<|endoftext|>", "<|endo", "Ċ", "Ã", "İ", "word", " the", "-", "’", "É", "À", "ÿ", "Ā"]
    texts = ["", " ", "\n", "é", "×", "a b", " a", "a ", *bits, ODD[5][1][:5_000]]
    texts += ["".join(r.choice(bits, r.integers(1, 40))) for _ in range(6_000)]
    pieces, tokenizer = to.Pieces(open(FILE, encoding="utf-8").read(), 0), Tokenizer.from_file(FILE)
    for some in (texts, texts[:1], texts[:3]):
        got = list(pieces.encode(pa.array(some).cast(pa.large_binary())))
        assert [list(ids) for ids in got] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in some]


def test_groups_and_other_splitters(monkeypatch):
    texts = [f"Some text {i % 7}, and 'more' of it's kind.\n\n Ends " for i in range(60)]
    monkeypatch.setattr(to, "GROUP_BYTES", 100)
    tokenizer = Tokenizer.from_file(FILE)
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace()
    for of in (Tokenizer.from_file(FILE), tokenizer):
        got = to.Pieces(of.to_str(), 9).encode(pa.array(texts).cast(pa.large_binary()))
        assert [list(ids) for ids in got] == [[*of.encode(t, add_special_tokens=False).ids, 9] for t in texts]


def test_an_equal_piece_is_encoded_once():
    pieces = to.Pieces(open(FILE, encoding="utf-8").read(), 0)
    texts = pa.array(["one two, three\n"] * 400).cast(pa.large_binary())
    seen = []
    real = pieces._pieces
    pieces._pieces = lambda some: seen.append(len(some)) or real(some)
    assert len(list(pieces.encode(texts))) == 400 and seen == [5]  # "one", " two", ",", " three", "\n"


def test_lanes_of_a_block_share_what_is_learned():
    r = np.random.default_rng(3)
    ids = np.tile(r.integers(0, 50_257, 3_000), 70)[:200_000]
    one = to.encode_blocks([ids])[0]
    assert (to.decode_blocks([one])[0] == ids).all()
    assert len(one) < 0.25 * 200_000  # an id alone takes about two bytes
    assert len(one) < len(b"".join(to.encode_blocks([ids[a:a + 4_096] for a in range(0, len(ids), 4_096)])))
    for lanes in (1, 2, 333):
        assert (to.decode_blocks(to.encode_blocks([ids[:5_000]], lanes))[0] == ids[:5_000]).all()


def test_random_damage_is_a_value_error():
    r = np.random.default_rng(4)
    whole = to.encode_blocks([r.zipf(1.2, 3_000) % 50_257])[0]
    for at in range(4, len(whole), 97):
        block = bytearray(whole)
        block[at] ^= 1 << int(r.integers(8))
        with pytest.raises(ValueError):
            to.decode_blocks([bytes(block)])
    with pytest.raises(ValueError):
        to.decode_blocks([whole[:-5]])
