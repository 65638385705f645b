import numpy as np
from fixtures import ODD, odd_documents, plain

from polderlake.llm import lm_score as lm


def test_gradients_equal_differences():
    net = {k: v.astype(np.float64) for k, v in lm.start().items()}
    ids, at, _ = lm.stream(["a b c a b d e f a b c"] * 3, lm.Tokens(list("abcdef")))
    for k, g in lm.gradients(net, ids, at).items():
        i = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        loss = []
        for step in (1e-5, -2e-5):
            net[k][i] += step
            loss.append(-lm.log_chances(net, ids, at).mean())
        net[k][i] += 1e-5
        assert abs(g[i] - (loss[0] - loss[1]) / 2e-5) < 1e-6


def test_chances_of_all_tokens_add_up_to_one():
    net = lm.start()
    ids, at, _ = lm.stream(["a b c d e"], lm.Tokens(list("abcde")))
    total = 0.0
    for token in range(lm.VOCABULARY):
        ids[at[2]] = token
        total += np.exp(lm.log_chances(net, ids, at[2:3])[0])
    assert abs(total - 1) < 1e-4


def test_a_token_is_never_its_own_context():
    net = lm.start()
    ids, at, _ = lm.stream(["a b c d e"], lm.Tokens(list("abcde")))
    hidden = lm.forward(net, ids, at)[0][2].copy()
    ids[at[2]] = 77
    assert (lm.forward(net, ids, at)[0][2] == hidden).all()


def test_training_helps_and_word_order_matters(spark):
    line = "one two three four five six seven eight "
    rows = [(i + 200, line * 200) for i in range(400)] + [
        (100, line * 3), (101, " ".join(reversed((line * 3).split()))), (102, None), (103, " ")]
    got = {r.doc_id: r for r in lm.score(spark, plain(spark, rows).coalesce(1)).collect()}
    assert len(got) == len(rows)
    assert got[100].mean_log_prob > got[101].mean_log_prob + 0.5
    assert got[100].mean_log_prob > -np.log(8)  # better than the words' frequencies
    assert got[102].n_tokens == 0 and got[102].mean_log_prob is None
    assert got[103].pseudo_log_likelihood == 0.0


def test_odd_rows_and_empty_table(spark):
    docs = odd_documents(spark)
    assert lm.score(spark, docs).count() == len(ODD)
    assert lm.score(spark, docs.limit(0)).collect() == []


def test_words_of_one_rare_token_have_chances_of_their_own(spark):
    common = [f"w{i}" for i in range(lm.VOCABULARY)]
    mates: dict = {}
    for i in range(10_000):
        mates.setdefault(lm.Tokens([])[f"rare{i}"], []).append(f"rare{i}")
    often, once = next(m for m in mates.values() if len(m) > 1)[:2]
    rows = [(i, " ".join(common)) for i in range(6)] + [(10, f"w1 w2 {often} w3"), (11, f"w1 w2 {once} w3"),
                                                        (12, f"{often} {often}")]
    got = {r.doc_id: r.pseudo_log_likelihood for r in lm.score(spark, plain(spark, rows)).collect()}
    assert abs(got[10] - got[11] - np.log(3)) < 1e-5


def test_shares_of_a_rare_token_add_up_to_one(spark):
    counts = spark.createDataFrame([(f"w{i}", i % 7 + 1) for i in range(3_000)], "word string, n long")
    words = lm.vocabulary(counts, lm.SIDE)
    tokens, total = lm.Tokens(words), {}
    for r in lm.shares(spark, counts, words, lm.SIDE).collect():
        total[tokens[r.word]] = total.get(tokens[r.word], 0.0) + np.exp(r.share)
    assert len(total) == tokens.rare and all(abs(x - 1) < 1e-9 for x in total.values())


def test_vocabulary_grows_with_the_distinct_words():
    assert [lm.side_of(n) ** 2 for n in (0, 10_000, 10 ** 8)] == [1_024, 1_024, 10_000]
    assert lm.start(40)["embed"].shape[1] == 1_601


def test_a_text_is_split_once_and_then_the_places_of_its_words(spark):
    wide = " ".join(f"w{i}" for i in range(70_000))  # more places than 16 bits
    rows = [(1, "b a B  a"), (2, None), (3, ""), (4, "c\tb\n"), (5, wide), (6, "a w69999")]
    cut = lm.blocks(spark, plain(spark, rows).coalesce(1)).toArrow()
    back = {}
    for packed, words, counts in zip(*(cut.column(c) for c in ("packed", "words", "counts"))):
        places, bounds, ids = lm.unpack(packed)
        words = words.as_py()
        assert len(set(words)) == len(words) and counts.as_py() == np.bincount(places).tolist()
        back |= {i.as_py(): [words[p] for p in places[a:b]] for i, a, b in zip(ids, bounds, bounds[1:])}
    assert back == {i: lm.words_of(t) for i, t in rows}
