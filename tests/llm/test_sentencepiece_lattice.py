import itertools
import random

import public_tokenizers
import pytest
import sentencepiece
from fixtures import ODD, odd_documents, plain

from polderlake.llm import sentencepiece_lattice as sl

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def table():
    return sl.load(MODEL)


def texts():
    r = random.Random(1)
    odd = ["a  b\n c\tx", "   ", "", "x" * 3_000, "ab" * 900 + " " + "the" * 300, "ﬁ Ａ é 😀 \x00 <s>", " the  quick "]
    return odd + ["".join(r.choice("abe thé中😀\n") for _ in range(r.randint(1, 300))) for _ in range(150)]


def test_ids_equal_the_library(table):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert sl.Lattice(table).encode(texts()) == library.encode(texts())


def test_documents_round_trip(spark, table):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, None), (5, "again ▁ here")]
    got = sl.round_trip(plain(spark, rows), table).collect()
    assert len(got) == len(rows) and all(r.decodes for r in got)


def test_viterbi_equals_brute_force():
    r = random.Random(2)
    pieces = ["a", "b", "ab", "ba", "aba", "bb", "abab"]
    scores = [r.uniform(-5, -1) for _ in pieces]
    table = sl.Pieces(["<unk>", *pieces], [0.0, *scores], [0], [], 0, "unigram", False)
    lattice = sl.Lattice(table)

    def best(word):
        found = []
        for n in range(1, len(word) + 1):
            for cut in itertools.combinations(range(1, len(word)), n - 1):
                parts = [word[i:j] for i, j in zip((0, *cut), (*cut, len(word)))]
                if all(p in pieces for p in parts):
                    found.append(sum(scores[pieces.index(p)] for p in parts))
        return max(found)

    for _ in range(60):
        word = "".join(r.choice("ab") for _ in range(r.randint(1, 9)))
        ids = lattice.encode_words([word])[0]
        assert "".join(table.texts[i] for i in ids) == word
        assert abs(sum(table.scores[i] for i in ids) - best(word)) < 1e-9
    assert lattice.encode_words(["axb", "a"]) == [[1, 0, 2], [1]]


def test_odd_rows_clashes_and_empty_table(spark, table):
    docs = odd_documents(spark).withColumnRenamed("at", "piece_ids")
    out = sl.encode(docs, table)
    assert out.count() == len(ODD) and out.columns[-1] == "piece_ids" and out.columns.count("piece_ids") == 1
    assert sl.encode(docs.limit(0), table).collect() == []


def test_words_of_single_blanks_are_those_of_the_pattern(monkeypatch):
    monkeypatch.setattr(sl, "REMEMBER", 3)  # words are forgotten between the calls
    texts = ["a b", " a b", "a b ", "a  b", "a", " ", "a\u2581b c", "a\nb c\t d", None, "", "é 漢 x"]
    for prefix in (True, False):
        pieces = sl.Pieces(["<unk>", "a", "b", "\u2581", "\u2581a", "\u2581b"], [0.0, -3, -4, -5, -1, -2], [0], [], 0, prefix=prefix)
        lattice = sl.Lattice(pieces)
        front = sl.BLANK if prefix else ""
        split = [sl.WORD.findall(front + t.replace(" ", sl.BLANK)) if t else [] for t in texts]
        assert [lattice.words(t) for t in texts] == split
        for _ in range(2):
            got = lattice.encode_array(texts)
            assert got.to_pylist() == [[i for w in words for i in lattice.encode_words([w])[0]] for words in split]
            assert str(got.type) == "list<item: int32>" and not got.null_count
