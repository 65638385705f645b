import hashlib
import re

from fixtures import ODD, odd_documents, plain

from polderlake.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute(text):
    found = []
    for k, (name, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "phone": 10 <= len(d) <= 15,
                "ip": name == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                "card": 14 <= len(d) <= 19 and luhn(d)}[name]:
                found.append((m.start(), k, m.end(), name))
    return [f"{n}:{a}:{b}" for a, _, b, n in sorted(found)]


TEXTS = [
    "a@b.c_d@e.f.g 😀 x@y.zz@q.w 1.2.3.4.5.6.7.8 001.2.3.255 999.1.1.1 é 4111 1111 1111 1111",
    "+1 (555) 010-9999 and +12 3 and 4111111111111112 and mail me: joe.x@mail.example.org.",
    "1-2 3-4 " * 400 + "9" * 20_000, "a" * 50_000 + "@b" + ".c" * 4_000, "1." * 3_000, "+" + "1(" * 5_000,
    "call +1 (826) 555-4081 190.137.223.204 now", "joe [at] mail [dot] com wrote", "version 12.4.1.9",
]


def test_base_spans_equal_the_contract(spark):
    rows = [(i, t) for i, t, _ in ODD if i != 7] + [(100 + i, t) for i, t in enumerate(TEXTS)]
    got = pii.digest(pii.find_personal_data(spark, plain(spark, rows))).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        base = brute(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(base) <= set(spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [
            sum(b.startswith(k + ":") for b in base) for k in PATTERNS]


def test_classifier_adds_what_the_strict_pattern_ran_over(spark):
    rows = [(i, f"mail u{i}@host{i}.com, call +1 (555) 010-{1000 + i}, host 10.0.0.{i % 250}")
            for i in range(60)] + [(99, TEXTS[6])]
    got = {r.doc_id: r for r in pii.find_personal_data(spark, plain(spark, rows)).collect()}
    assert [s.value for s in got[99].added if s.kind == pii.KINDS.index("phone")] == ["+1 (826) 555-4081"]


def test_label_model_trusts_the_labeler_that_agrees():
    code = lambda votes, k=0: (lambda c: c * 16)(
        __import__("functools").reduce(lambda c, v: 3 * c + v, votes, k))
    good, bad = code([2, 2, 2, 2, 1]), code([1, 0, 0, 0, 0])
    p = pii.fit_label_model({good: 500, bad: 500})
    assert p[good] > 0.95 and p[bad] < 0.05
    assert pii.decode(good) == (0, [2, 2, 2, 2, 1], [0, 0, 0, 0])
    s = pii.fit_classifier({good: 500, bad: 500}, p)
    assert s[good] > 0.8 and s[bad] < 0.2
    assert pii.fit_label_model({}) == {} and pii.fit_classifier({}, {}) == {}


def test_odd_rows_empty_table_and_plan(spark):
    docs = odd_documents(spark)
    assert pii.find_personal_data(spark, docs).count() == len(ODD)
    assert pii.find_personal_data(spark, docs.limit(0)).collect() == []
    text = docs.select("doc_id", "text").withColumn("base", pii.base_spans())
    assert "Python" not in text._jdf.queryExecution().toString()
