import random

import numpy as np
import pyarrow as pa
from fixtures import odd_documents

from polderlake.llm import language_id as li

SYLLABLES = {"aa": ["ka", "to", "mi", "ra", "nu"], "bb": ["sch", "ung", "äu", "ver", "eit"],
             "cc": ["éa", "oix", "que", "lle", "ment"]}


def text(r, lang, n):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 3))) for _ in range(n))


def labelled(spark, n=900):
    r = random.Random(2)
    rows = []
    for i in range(n):
        lang = r.choices(list(SYLLABLES), [8, 1, 1])[0]  # one language holds most
        rows.append((i, text(r, lang, r.choice([3, 20, 150])), lang if i % 11 else None, lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")


def test_held_out_accuracy_and_same_result_again(spark):
    docs = labelled(spark)
    out = li.identify(spark, docs).join(docs, "doc_id").collect()
    assert len(out) == 900 and all(0 <= r["score"] <= 1 for r in out)
    for lang in SYLLABLES:
        held = [r for r in out if r["held_out"] and r["truth"] == lang]
        assert held and sum(r["lang_pred"] == lang for r in held) >= 0.97 * len(held)
    again = {r["doc_id"]: r["score"] for r in li.identify(spark, docs.repartition(3)).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in out)


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs = labelled(spark)
    wrong = docs.selectExpr("doc_id", "text", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, "
                            "'zz', lang) lang")
    assert li.training_rows(wrong).where("lang = 'zz'").count() == 0
    assert li.training_rows(docs, 30).groupBy("lang").count().where("count > 10").count() == 0


def test_windows_hold_every_byte_once():
    r = random.Random(1)
    texts = ["", "a", "é" * 500, "x" * li.WINDOW, "y" * (li.WINDOW + 1), text(r, "bb", 900)]
    cut, owner, held = li.windows_of(pa.array(texts).cast(pa.binary()))
    for i, t in enumerate(texts):
        mine = owner == i
        assert b"".join(c[:h].tobytes() for c, h in zip(cut[mine], held[mine])) == t.encode()
        assert not any(c[h:].any() for c, h in zip(cut[mine], held[mine]))


def plain_chances(net, window):
    """The network spelt out place by place."""
    pooled = []
    for w in li.WIDTHS:
        for f in range(li.FILTERS):
            answers = [sum(net["embed"][window[p + k]] @ net[f"filter{w}"][k, :, f] for k in range(w))
                       for p in range(len(window) - w + 1)]
            pooled.append(max(max(answers), 0))
    z = np.array(pooled) @ net["out"] + net["out_bias"]
    return np.exp(z - z.max()) / np.exp(z - z.max()).sum()


def test_forward_and_lookups_equal_the_network_spelt_out():
    net = li.start(3)
    cut = np.random.default_rng(4).integers(0, 256, (3, li.WINDOW)).astype(np.uint8)
    want = np.array([plain_chances(net, c) for c in cut])
    np.testing.assert_allclose(li.forward(net, cut)[2], want, atol=1e-5)
    np.testing.assert_allclose(li.chances(net, li.lookups(net), cut), want, atol=1e-5)


def test_gradients_follow_the_loss():
    net = {k: v.astype(np.float64) for k, v in li.start(3).items()}
    r = np.random.default_rng(5)
    cut, label = r.integers(0, 256, (5, li.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    loss = lambda: -np.log(li.forward(net, cut)[2][np.arange(5), label]).mean()
    for name, g in li.gradients(net, cut, label).items():
        for at in [np.unravel_index(i, g.shape) for i in np.argsort(-np.abs(g).ravel())[:4]]:
            old, step = net[name][at], 1e-6
            net[name][at] = old + step
            up = loss()
            net[name][at] = old - step
            down = loss()
            net[name][at] = old
            np.testing.assert_allclose(g[at], (up - down) / (2 * step), rtol=1e-3, atol=1e-7)


def test_odd_rows_and_empty_tables(spark):
    docs = odd_documents(spark)
    out = {r["doc_id"]: r for r in li.identify(spark, docs).collect()}
    assert docs.count() == sum(1 for _ in li.identify(spark, docs).collect())
    for i in (3, 4, 5, 9):
        assert (out[i]["lang_pred"], out[i]["score"]) == ("und", 0.0)
    assert out[None]["held_out"] and out[1]["lang_pred"] in {"en", "fr", "es"}
    assert li.identify(spark, docs.limit(0)).collect() == []
    none = docs.drop("lang").selectExpr("*", "cast(null as string) lang")
    assert {r["lang_pred"] for r in li.identify(spark, none).collect()} == {"und"}
    one = spark.createDataFrame([(2, "1 2 3", "en"), (3, "abc", "en")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in li.identify(spark, one).collect()}[2] == "und"


def test_chances_of_a_window_do_not_depend_on_the_windows_beside_it():
    net = li.start(3)
    cut = np.random.default_rng(0).integers(97, 123, (301, li.WINDOW)).astype(np.uint8)
    tables = li.lookups(net)
    whole = li.chances(net, tables, cut)
    for size in (1, 2, 5, 100):
        parts = [li.chances(net, tables, cut[i:i + size]) for i in range(0, len(cut), size)]
        assert np.abs(np.concatenate(parts) - whole).max() < 1e-12
