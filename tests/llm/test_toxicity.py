import random
import zlib

from fixtures import ODD, odd_documents

from polderlake.llm import toxicity as tx

CLEAN = "the river runs past old mills and quiet gardens where people walk at noon with dogs".split()


def labelled(spark, n=600):
    r = random.Random(7)
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(CLEAN) + r.choice(["", "s", "er"]) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w[r.randrange(60)] = r.choice(["blargface", "morvik" + r.choice(["al", "en", "os", "um"])])
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_automaton_equals_edit_distance():
    r = random.Random(1)
    terms = ["idiot", "scum", "worthless", "moron", "morons"]
    machine = tx.Automaton(terms, ["lowei"], ["strictly"])
    for _ in range(3_000):
        word = list(r.choice([*terms, "strictly"]))
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(word))
            word[at] = r.choice(["", "x", word[at] + "o"])
            word = [c for c in "".join(word)] or ["q"]
        word = "".join(word)
        near = [t for t in terms if distance(word, t) <= tx.allowed(t)]
        want = "exact" if word in (*terms, "strictly") else "fuzzy" if near else None
        assert machine.look_up(word) == want
    assert machine.look_up("loweischaft") == "stem" and machine.look_up("lowe") is None


def test_learns_terms_and_stems_and_scores_held_out_rows(spark):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    model = tx.fit(spark, docs, labels)
    assert "blargface" in model.terms and any(s.startswith("morv") for s in model.stems)
    rows = tx.toxicity(spark, docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert len(held) > 80 and all(r.predicted == truth[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert tx.drop_toxic(spark, docs, labels).count() == sum(1 - t for t in truth.values())


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = labelled(spark, 300)
    flipped = labels.withColumn("toxic", tx.F.when(
        tx.held_out("doc_id"), 1 - tx.F.col("toxic")).otherwise(tx.F.col("toxic")))
    score = lambda lab: {r.doc_id: r.score for r in tx.toxicity(spark, docs, lab).collect()}
    assert score(labels) == score(flipped)


def test_misspellings_and_quotations(spark):
    scan = tx.Scanner(["idiot", "worthless"], [], [], {"idiom"})
    assert scan.features("nothing here") == [0.0] * len(tx.FEATURES)
    one = dict(zip(tx.FEATURES, scan.features("you are an idjot")))
    assert one["fuzzy"] > 0 and one["abuse"] > 0 and one["addressed"] > 0
    quoted = dict(zip(tx.FEATURES, scan.features('he wrote “worthless idiot” on the wall')))
    assert quoted["quoted"] > 0 and quoted["abuse"] == 0
    assert scan.features("a fine idiom") == [0.0] * len(tx.FEATURES)


def test_odd_rows_and_empty_tables(spark):
    docs, (_, labels) = odd_documents(spark), labelled(spark, 8)
    assert tx.toxicity(spark, docs, labels).count() == len(ODD)
    assert tx.toxicity(spark, docs, labels.limit(0)).count() == len(ODD)
    assert tx.toxicity(spark, docs.limit(0), labels).collect() == []
    assert tx.drop_toxic(spark, docs, labels).columns == docs.columns


def test_rare_terms_are_matched_with_edits(spark):
    r, docs, labels = random.Random(9), [], []
    terms = ["".join(r.choice("bcdfgklmnprtvz") for _ in range(9)) for _ in range(40)]
    for i in range(1_600):
        w = [r.choice(CLEAN) + r.choice(["", "s", "er"]) for _ in range(60)]
        if i % 2:
            for k in range(3):
                w[20 * k + r.randrange(20)] = terms[(i // 2 * 3 + k) % len(terms)]
        docs.append((i, " ".join(w)))
        labels.append((i, 1, i % 2))
    # One clean and some toxic training texts spell a term wrongly; it is no word of its own.
    wrong = "q" + terms[0][1:]
    for i, toxic in ((2_001, 0), (2_002, 1), (2_003, 1), (2_004, 1), (2_005, 1), (2_006, 1), (2_007, 1)):
        docs.append((i, f"{' '.join(CLEAN)} {wrong} {i}"))
        labels.append((i, 1, toxic))
    model = tx.fit(spark, spark.createDataFrame(docs, "doc_id long, text string"),
                   spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    scan = model.scanner()
    assert set(terms) <= set(model.terms)
    for t in terms:
        assert scan.hits("x" + t)[1], t
    assert scan.hits(wrong)[1]


def test_forms_of_their_own_right_by_their_share_in_both_classes():
    assert tx.own_right(0, 1, 100, 900) and tx.own_right(2, 40, 100, 900)
    assert not tx.own_right(3, 1, 100, 900) and not tx.own_right(0, 0, 100, 900)


def test_misspelt_toxic_texts_are_still_caught(spark):
    """One letter changed in every learned term of the held-out toxic texts."""
    docs, labels = labelled(spark)
    model = tx.fit(spark, docs, labels)
    scan = model.scanner()
    rows = docs.join(labels, "doc_id").where(tx.held_out("doc_id")).collect()
    toxic = [r.text for r in rows if r.toxic]
    wrong = [tx.misspelt(t, scan.hits(t)[1]) for t in toxic]
    assert all(a != b and len(a) == len(b) for a, b in zip(toxic, wrong))
    assert (model.scores(scan, wrong) >= 0.5).mean() >= 0.85
    assert (model.scores(scan, [r.text for r in rows if not r.toxic]) < 0.5).mean() >= 0.99
    assert model.weights[tx.FEATURES.index("fuzzy")] >= 0


def test_a_term_among_clean_words_allows_fewer_edits(spark):
    rows = [(f"t {w} x{i}", 1) for i in range(20) for w in ("worthless", "moronic")]
    rows += [(f"c {w} y{i}", 0) for i, w in enumerate(["worthlest", "worthlesp", "worthlesd"] * 40)]
    df = spark.createDataFrame(rows, "text string, toxic int")
    got = tx.allowed_edits(spark, df, {"worthless": 20, "moronic": 20}, [], {1: 40, 0: 120})
    assert got == {"worthless": 0}
    machine = tx.Automaton(["worthless", "moronic"], [], [], got)
    assert [machine.look_up(w) for w in ("worthless", "worthlest", "moronyc")] == ["exact", None, "fuzzy"]
    assert machine.near("moronyc") == [("moronic", 1)]


def test_label_ties_have_a_rule(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate("aabbbcd")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (3, 0), (4, 1), (5, 0), (5, 1), (6, None)],
                                   "doc_id long, toxic int")
    held = {i for i in range(7) if zlib.crc32(str(i).encode()) % 5 == 0}
    want: dict[str, list] = {}
    for i, t in enumerate("aabbbc"):
        if i not in held:
            want.setdefault(t, []).append({0: 0, 1: 1, 2: 0, 3: 0, 4: 1, 5: 1}[i])
    got = {r.text: r.toxic for r in tx.training_rows(docs, labels).collect()}
    assert got == {t: int(2 * sum(v) >= len(v)) for t, v in want.items()}
