"""Personal data: base patterns, weak supervision over wider candidates, a span classifier.

Every text yields base spans (four strict patterns) and wider candidates around them: numbers
and addresses written in other ways. Labelers vote on each span: the strict pattern, its
written shape, gazetteers (domain endings, calling codes, issuer prefixes), and words before
and after it. Expectation-maximisation over the counts of vote patterns estimates how reliable
each labeler is and gives each pattern a probability. A logistic classifier over span features
learns from those probabilities and decides which candidates join the base spans.

All work on texts is built-in expressions. Only the counts of vote and feature patterns reach
the driver; a pattern is a kind, five votes of three values and four features of two, so there
are at most 4 * 3**5 * 2**4 = 15,552 of them whatever the size of the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polderlake.llm.common import staged, text_or_empty

KINDS = ("email", "ip", "card", "phone")

# The base patterns of the contract. Possessive repeats and the start conditions change no
# match; they keep the work linear on long runs and off the thread's stack.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

# Wider forms: an address with its signs spelt out; a colon-grouped address; a payment number
# of sixteen digits in even groups and a telephone number with an area code, also where the
# strict pattern ran on into the next number and so failed.
WIDE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Z0-9._%+-]{2,64}\x20?[\[({]\x20?at\x20?[\])}]\x20?"
             r"[A-Z0-9-]{2,64}(?:\x20?(?:[\[({]\x20?dot\x20?[\])}]|\.)\x20?[A-Z]{2,24}){1,4}",
    "ip": r"(?i)(?<![0-9A-F:.])(?:[0-9A-F]{1,4}:){7}[0-9A-F]{1,4}(?![0-9A-F:.])",
    "card": r"(?<![0-9.])[0-9]{4}([\x20./-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9.])",
    "phone": r"(?<![0-9A-Za-z+.)-])(?:\+[1-9][0-9]{0,2}[\x20.-]?)?"
             r"(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"
             r"|(?<![0-9A-Za-z+.)-])00[1-9][0-9]{0,2}(?:[\x20-][0-9]{2,4}){2,5}(?![0-9A-Za-z])",
}

# Words that speak for a kind, and words that speak against any.
CUES = {
    "email": r"\b(?:e-?mail|mail|contact|write|correo|courriel|kontakt|reply)\b",
    "ip": r"\b(?:ip|host|server|address|adresse|client|login|addr)\b",
    "card": r"\b(?:card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta)\b",
    "phone": r"\b(?:tel|phone|call|mobile|cell|fax|whatsapp|telefon|telefono|téléphone)\b",
}
AGAINST = r"\b(?:version|isbn|issn|doi|order|invoice|ref|serial|part|section|rfc|page)\b[^a-z]*$"
ENDINGS = r"(?i)(?:com|org|net|edu|gov|info|io|biz|eu|de|fr|es|uk|nl|it|ch|at|be|us|ca)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"
CALLING = r"^(?:[+]|00)?(?:1|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"

LABELERS = 5
WINDOW = 40


def _matches(kind: str, pattern: str) -> str:
    """SQL for the matches of a pattern as ``array<struct<start, end, kind, value>>``.

    Java's split and find walk the same matches, so the pieces between them give positions.
    """
    p = "r'" + pattern + "'"
    return f"""aggregate(
        zip_with(split(text, {p}, -1), regexp_extract_all(text, {p}, 0),
                 (gap, hit) -> struct(length(gap) AS gap, hit AS hit)),
        struct(0 AS at, cast(array() AS array<struct<start:int,kind:int,end:int,value:string>>) AS hits),
        (s, x) -> struct(
            s.at + x.gap + coalesce(length(x.hit), 0) AS at,
            if(x.hit IS NULL, s.hits, array_append(s.hits, named_struct(
                'start', s.at + x.gap, 'kind', {KINDS.index(kind)},
                'end', s.at + x.gap + length(x.hit), 'value', x.hit))) AS hits),
        s -> s.hits)"""


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    """From the right, every second digit is doubled and its digits added."""
    return f"""aggregate(
            transform(split(reverse({d}), ''), (c, i) ->
                if(i % 2 = 0, int(c), 2 * int(c) - if(int(c) > 4, 9, 0))),
            0, (s, v) -> s + v) % 10 = 0"""


def _valid(kind: str, x: str) -> str:
    """SQL for the check that a match of a base pattern must pass."""
    d = _digits(f"{x}.value")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return f"{x}.value RLIKE '^{part}([.]{part}){{3}}$'"
    if kind == "card":
        return f"length({d}) BETWEEN 14 AND 19 AND {_luhn(d)}"
    return f"length({d}) BETWEEN 10 AND 15" if kind == "phone" else "true"


#: What a text must hold for a pattern to be tried at all.
_NEEDS = {"email": "contains(text, '@')", "ip": "contains(text, '.') AND text RLIKE '[0-9]'",
          "card": "text RLIKE '[0-9]'", "phone": "contains(text, '+')"}
_NEEDS_WIDE = {"email": r"text RLIKE r'(?i)[\[({]\x20?at\x20?[\])}]'",
               "ip": "contains(text, ':') AND text RLIKE '[0-9]'",
               "card": "text RLIKE '[0-9]{4}[ ./-]?[0-9]{4}'",
               "phone": "text RLIKE '[0-9]{2,3}[)]?[ .-][0-9]{2,4}'"}
_NONE = "cast(array() AS array<struct<start:int,kind:int,end:int,value:string>>)"


def base_spans() -> Column:
    """All base spans of ``text``, by start and then kind."""
    each = [f"if({_NEEDS[k]}, filter({_matches(k, BASE[k])}, x -> {_valid(k, 'x')}), {_NONE})"
            for k in KINDS]
    return F.expr(f"array_sort(concat({', '.join(each)}))")


def wide_spans() -> Column:
    """Wider candidates of ``text`` that touch no base span (column ``base``)."""
    each = [f"if({_NEEDS_WIDE[k]}, {_matches(k, WIDE[k])}, {_NONE})" for k in KINDS]
    return F.expr(f"""filter(array_sort(concat({', '.join(each)})),
        x -> NOT exists(base, b -> b.start < x.end AND x.start < b.end))""")


def _vote(yes: str, no: str = "false") -> str:
    """2 for, 0 against, 1 abstains."""
    return f"(CASE WHEN {yes} THEN 2 WHEN {no} THEN 0 ELSE 1 END)"


def _by_kind(kind: str, texts: dict[str, str]) -> str:
    return ("(CASE " + " ".join(f"WHEN {kind} = {KINDS.index(k)} THEN {v}" for k, v in texts.items())
            + " END)")


def pattern_code(spans: str, is_base: bool) -> Column:
    """For each span of the array, its kind, votes and features as one number."""
    before = f"lower(substring(text, greatest(x.start - {WINDOW}, 0) + 1, least(x.start, {WINDOW})))"
    after = f"lower(substring(text, x.end + 1, {WINDOW}))"
    v, digits = "x.value", _digits("x.value")
    shape = _by_kind("x.kind", {
        "email": r"x.value RLIKE r'^[A-Za-z0-9][^@]*[@\[({]' AND length(x.value) <= 128",
        "ip": "x.value NOT RLIKE '(^|[.])0[0-9]'",
        "card": _luhn(digits),
        "phone": "x.value RLIKE '[() .-]'"})
    listed = _by_kind("x.kind", {
        "email": f"{v} RLIKE r'{ENDINGS}'", "ip": f"{v} NOT RLIKE '^(0|255)[.]'",
        "card": f"{digits} RLIKE '{ISSUERS}'", "phone": rf"{v} RLIKE r'{CALLING}' OR {v} NOT RLIKE '^([+]|00)'"})
    unlisted = _by_kind("x.kind", {
        "email": f"{v} NOT RLIKE r'{ENDINGS}'", "ip": f"{v} RLIKE '^(0|255)[.]'",
        "card": f"{digits} NOT RLIKE '{ISSUERS}'", "phone": "false"})
    cue = lambda where: _by_kind("x.kind", {k: f"{where} RLIKE r'{CUES[k]}'" for k in KINDS})
    votes = [
        "2" if is_base else "1",
        _vote(shape, f"NOT ({shape})"),
        _vote(listed, unlisted),
        _vote(cue("before"), f"before RLIKE r'{AGAINST}'"),
        _vote(cue("after"), "after RLIKE '^[a-z0-9]'"),
    ]
    features = [
        f"int({before} RLIKE '[a-z0-9]$')",
        f"int(length({digits}) >= 9)",
        "int(x.value RLIKE '[a-zA-Z]')",
        "int(x.value RLIKE '[ ()-]')",
    ]
    code = "x.kind"
    for vote in votes:
        code = f"3 * ({code}) + {vote.replace('before', before).replace('after', after)}"
    for feature in features:
        code = f"2 * ({code}) + {feature}"
    return F.expr(f"transform({spans}, x -> int({code}))")


def decode(code: int) -> tuple[int, list[int], list[int]]:
    """Kind, votes (0 against, 1 abstains, 2 for) and features of a pattern code."""
    features, votes = [], []
    for _ in range(4):
        code, f = divmod(code, 2)
        features.append(f)
    for _ in range(LABELERS):
        code, v = divmod(code, 3)
        votes.append(v)
    return code, votes[::-1], features[::-1]


def fit_label_model(counts: dict[int, int], rounds: int = 25) -> dict[int, float]:
    """Expectation-maximisation over vote patterns: the probability of each pattern.

    For each kind: a prior, and for each labeler the chance of each of its three votes on true
    and on false spans. Both start from and are smoothed towards labelers that are right four
    times in five when they vote.
    """
    belief = {True: (0.08, 0.4, 0.52), False: (0.52, 0.4, 0.08)}
    strength = 20.0
    prior = [0.5] * len(KINDS)
    chance = {(k, j, t): list(belief[t])
              for k in range(len(KINDS)) for j in range(LABELERS) for t in (True, False)}
    posterior: dict[int, float] = {}
    for _ in range(rounds):
        for code in counts:
            k, votes, _ = decode(code)
            odds = math.log(prior[k] / (1 - prior[k]))
            for j, v in enumerate(votes):
                odds += math.log(chance[k, j, True][v] / chance[k, j, False][v])
            posterior[code] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        mass: dict[tuple, float] = {}
        for code, n in counts.items():
            k, votes, _ = decode(code)
            for t, p in ((True, posterior[code]), (False, 1 - posterior[code])):
                mass[k, t] = mass.get((k, t), 0.0) + n * p
                for j, v in enumerate(votes):
                    mass[k, j, t, v] = mass.get((k, j, t, v), 0.0) + n * p
        for k in range(len(KINDS)):
            yes, no = mass.get((k, True), 0.0), mass.get((k, False), 0.0)
            prior[k] = (yes + strength / 2) / (yes + no + strength)
            for j in range(LABELERS):
                for t in (True, False):
                    total = mass.get((k, t), 0.0) + strength
                    chance[k, j, t] = [
                        (mass.get((k, j, t, v), 0.0) + strength * belief[t][v]) / total
                        for v in range(3)]
    return posterior


def _inputs(code: int) -> list[int]:
    """Positions of the classifier's inputs that are one: bias, kind, votes, features."""
    k, votes, features = decode(code)
    at = 1 + len(KINDS)
    on = [0, 1 + k]
    on += [at + 2 * j + (v == 2) for j, v in enumerate(votes) if v != 1]
    at += 2 * LABELERS
    return on + [at + j for j, f in enumerate(features) if f]


def fit_classifier(counts: dict[int, int], target: dict[int, float],
                   steps: int = 300) -> dict[int, float]:
    """Logistic regression on the label model's probabilities; the score of each pattern.

    Each pattern weighs by the logarithm of its count, so that a frequent one cannot drown
    the others.
    """
    size = 1 + len(KINDS) + 2 * LABELERS + 4
    weights = [0.0] * size
    rows = [(_inputs(c), target[c], math.log1p(n)) for c, n in sorted(counts.items())]
    total = sum(n for _, _, n in rows) or 1.0
    score = lambda on: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[i] for i in on)))))
    for _ in range(steps):
        gradient = [1e-3 * w for w in weights]
        for on, y, n in rows:
            g = (score(on) - y) * n / total
            for i in on:
                gradient[i] += g
        weights = [w - 1.0 * g for w, g in zip(weights, gradient)]
    return {c: score(_inputs(c)) for c in counts}


def find_personal_data(spark: SparkSession, docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per input row: ``doc_id, base, added`` (arrays of spans with their values).

    ``base`` are the spans of the strict patterns, all of them. ``added`` are candidates that
    the trained classifier accepts; they overlap no base span. A span is ``start, kind, end,
    value`` in code points, ``end`` exclusive, sorted by start and kind. Null and empty texts
    have none. Repeated rows give repeated rows, null ids stay null, other columns are not read.
    """
    text = docs.select("doc_id", text_or_empty().alias("text"))
    spans = (text.withColumn("base", base_spans()).withColumn("wide", wide_spans())
             .withColumn("base_code", pattern_code("base", True))
             .withColumn("wide_code", pattern_code("wide", False)).drop("text"))
    spans = staged(spark, spans, "personal-data-spans")
    counts = {r["code"]: r["count"] for r in spans.select(
        F.explode(F.concat("base_code", "wide_code")).alias("code")).groupBy("code").count().collect()}
    scores = fit_classifier(counts, fit_label_model(counts))
    accepted = sorted(c for c, s in scores.items() if s >= threshold)
    accepts = f"array_contains(cast(array({', '.join(map(str, accepted))}) AS array<int>), x.code)"
    added = F.expr(f"""transform(
        filter(zip_with(wide, wide_code, (w, c) -> struct(w AS span, c AS code)), x -> {accepts}),
        x -> x.span)""")
    return spans.select("doc_id", "base", added.alias("added"))


def _joined(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')")


def digest(found: DataFrame) -> DataFrame:
    """Counts and hash of the base spans, and all spans as text."""
    count = lambda k: F.expr(f"cast(size(filter(base, x -> x.kind = {KINDS.index(k)})) AS bigint)")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(_joined("base"), 256).alias("base_sha256"),
                        _joined("array_sort(concat(base, added))").alias("spans"))
