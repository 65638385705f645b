"""Toxicity: Levenshtein automata over a lexicon trie, weighed by the words around a hit.

A lexicon of abusive terms grows out of the labelled texts: words and word stems that toxic
texts hold far more often than others, in several different surroundings. Its trie intersected
with the Levenshtein automata of its terms is one machine, made deterministic as it is walked:
a word passes through it character by character and is a hit when some term lies within the
edits that the term's length allows. A form that training texts hold at clean texts' rate is a
word of its own right and no hit. A term keeps only the edits at which its neighbours are rare
in clean texts: among many clean words of similar spelling it allows fewer. Each hit is weighed by its window: quotation marks and
words of reporting speak for a quotation, words of address for abuse. A logistic model over a
text's hits gives the score; it is trained on the texts and on copies of the toxic ones whose
hits are misspelt, each with the exceptions that the other half of the texts showed.

Training reads at most ``max_labelled`` labelled texts, those of the smallest hash of their id;
scoring reads every text whole, in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LABELLED = 50_000
MAX_STATES = 200_000  # that an automaton remembers
STEMS = (4, 5, 6)
MIN_TEXTS = 4  # toxic training texts that a term needs, in as many different surroundings
RATIO = 20.0  # how much more often than in other texts
STEM_GAIN = 1.3  # how many more texts a stem has than any longer term
NEAR_RATIO = 2.0  # how much more often a term must be in toxic texts than its neighbours in clean ones
FORM_RATIO = 2.0  # a form near a term counts if so much more frequent in toxic texts

#: Abuse that needs no labels to be known.
SEED_TERMS = ("idiot", "moron", "imbecile", "scum", "worthless", "disgusting", "pathetic",
              "stupid", "loser", "bastard", "asshole", "scumbag", "dumbass", "retard", "cretin")
ADDRESS = frozenset("you your youre u ur yourself yourselves tu ton vous votre du dich dein ihr "
                    "euch eres usted tú te are such shut hate kill".split())
REPORT = frozenset("said says say called calls wrote writes word words term terms quote quoted "
                   "quotes insult insults slur meaning title named dit sagte dijo wort mot palabra"
                   .split())
WINDOW = 4

WORD = re.compile(r"[^\W_]+(?:[@$0-9*!]+[^\W_]+)*")
QUOTED = re.compile(r"\"[^\"\n]{1,400}\"|“[^”\n]{1,400}”|«[^»\n]{1,400}»|„[^“”\n]{1,400}[“”]")
FEATURES = ("any", "abuse", "quoted", "stems", "fuzzy", "addressed", "terms", "density")
#: Weights without training and the centre they are shrunk to with it; the last is the bias.
PRIOR = np.array([2.0, 1.0, 0.0, 1.0, 0.5, 0.5, 1.0, 2.0, -3.5])


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def allowed(term: str) -> int:
    """Edits within which a word counts as the term."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


@dataclass
class Automaton:
    """Trie of terms and stems intersected with their Levenshtein automata.

    A state is the set of (trie node, edits used) pairs that the letters so far can reach.
    States and steps are made when first met and kept.
    """

    terms: list[str]
    stems: list[str]
    strict: list[str] = field(default_factory=list)  # terms that must be met exactly
    edits: dict[str, int] = field(default_factory=dict)  # of terms that allow other than ``allowed``
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])

    def __post_init__(self):
        self.term_at: dict[int, int] = {}
        self.stem_at: set[int] = set()
        self.most: list[int] = [0]  # edits that some term below a node allows
        self.named: dict[int, str] = {}
        for t in [*self.terms, *self.strict]:
            most = 0 if t in self.strict else self.edits.get(t, allowed(t))
            node = self._add(t, most)
            self.term_at[node], self.named[node] = most, t
        for s in self.stems:
            self.stem_at.add(self._add(s, 0))
        self._restart()

    def _restart(self) -> None:
        start = self._closed({0: 0})
        self.states: list[dict[int, int]] = [start]
        self.known = {self._key(start): 0}
        self.steps: list[dict[str, int]] = [{}]

    def _add(self, word: str, edits: int) -> int:
        node = 0
        self.most[0] = max(self.most[0], edits)
        for c in word:
            nxt = self.children[node].get(c)
            if nxt is None:
                nxt = self.children[node][c] = len(self.children)
                self.children.append({})
                self.most.append(0)
            node = nxt
            self.most[node] = max(self.most[node], edits)
        return node

    @staticmethod
    def _key(state: dict[int, int]):
        return frozenset(state.items())

    def _closed(self, state: dict[int, int]) -> dict[int, int]:
        """With the nodes that leaving out letters of a term reaches."""
        stack = list(state.items())
        while stack:
            node, e = stack.pop()
            for child in self.children[node].values():
                if e < self.most[child] and state.get(child, 99) > e + 1:
                    state[child] = e + 1
                    stack.append((child, e + 1))
        return state

    def _step(self, at: int, c: str) -> int:
        nxt: dict[int, int] = {}
        for node, e in self.states[at].items():
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.most[child] and cost < nxt.get(child, 99):
                    nxt[child] = cost
            if e < self.most[node] and e + 1 < nxt.get(node, 99):
                nxt[node] = e + 1
        nxt = self._closed(nxt)
        key = self._key(nxt)
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(nxt)
            self.steps.append({})
        self.steps[at][c] = self.known[key]
        return self.known[key]

    def look_up(self, word: str) -> str | None:
        """"exact", "stem" or "fuzzy" when the word is a hit."""
        if len(self.states) > MAX_STATES:
            self._restart()
        at = 0
        for c in word:
            nxt = self.steps[at].get(c)
            at = self._step(at, c) if nxt is None else nxt
            state = self.states[at]
            if not state:
                return None
            if any(state.get(s) == 0 for s in self.stem_at & state.keys()):
                return "stem"
        edits = [e for node, e in self.states[at].items()
                 if node in self.term_at and e <= self.term_at[node]]
        return None if not edits else "exact" if min(edits) == 0 else "fuzzy"

    def near(self, word: str) -> list[tuple[str, int]]:
        """The terms within whose edits a word lies, with its distance from each."""
        at = 0
        for c in word:
            nxt = self.steps[at].get(c)
            at = self._step(at, c) if nxt is None else nxt
        return [(self.named[node], e) for node, e in self.states[at].items()
                if node in self.term_at and e <= self.term_at[node]]


class Scanner:
    """Hits and features of texts; remembers the words it has looked up, up to a bound."""

    REMEMBER = 400_000

    def __init__(self, terms: list[str], stems: list[str], strict: list[str],
                 exceptions: set[str], edits: dict[str, int] | None = None):
        self.automaton = Automaton(terms, stems, strict, edits or {})
        self.exceptions = exceptions
        self.seen: set[str] = set()
        self.forms: dict[str, str] = {}

    def hits(self, text: str) -> tuple[list[str], set[str]]:
        tokens = words(text)
        distinct = set(tokens)
        new = distinct - self.seen
        if len(self.seen) + len(new) > self.REMEMBER:
            self.seen = set()
        for w in new:
            kind = self.automaton.look_up(w)
            if kind and not (kind == "fuzzy" and w in self.exceptions):
                self.forms[w] = kind
        self.seen |= new
        return tokens, distinct & self.forms.keys()

    def features(self, text: str) -> list[float]:
        tokens, found = self.hits(text)
        if not found:
            return [0.0] * len(FEATURES)
        lower = text.lower()
        quotes = [m.span() for m in QUOTED.finditer(lower)]
        count: Counter = Counter()
        for i, m in enumerate(WORD.finditer(lower)):
            kind = self.forms.get(m.group()) if m.group() in found else None
            if kind is None:
                continue
            around = tokens[max(0, i - WINDOW):i] + tokens[i + 1:i + 1 + WINDOW]
            quoted = any(a <= m.start() and m.end() <= b for a, b in quotes)
            quoted = quoted or any(w in REPORT for w in tokens[max(0, i - WINDOW):i])
            count["quoted" if quoted else "abuse"] += 1
            count["addressed"] += not quoted and any(w in ADDRESS for w in around)
            count[kind] += 1
        n = count["abuse"] + count["quoted"]
        return [float(n > 0), math.log1p(count["abuse"]), math.log1p(count["quoted"]),
                math.log1p(count["stem"]), math.log1p(count["fuzzy"]),
                math.log1p(count["addressed"]), math.log1p(len(found)),
                min(1.0, 20.0 * count["abuse"] / len(tokens))]


@dataclass
class Model:
    terms: list[str]
    stems: list[str]
    exceptions: set[str]
    weights: np.ndarray
    edits: dict[str, int] = field(default_factory=dict)

    def scanner(self) -> Scanner:
        return Scanner(self.terms, self.stems, [], self.exceptions, self.edits)

    def parts(self) -> tuple:
        return self.terms, self.stems, self.exceptions, self.weights, self.edits

    def scores(self, scanner: Scanner, texts: list[str | None]) -> np.ndarray:
        rows = np.array([scanner.features(t or "") for t in texts]).reshape(-1, len(FEATURES))
        odds = rows @ self.weights[:-1] + self.weights[-1]
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -30, 30)))


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``text, toxic`` of labelled rows outside the held-out fifth, one per text.

    An id with several labels is toxic if one says so; a text under several ids has the label
    of most of them, and is toxic if they are as many.
    """
    ids = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
           .where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    return (docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
            .groupBy(F.coalesce("text", F.lit("")).alias("text"))
            .agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic")))


def _candidates(text: str) -> Iterator[tuple[str, str]]:
    """Words and stems of a text, a stem marked by a star, each with the word before."""
    before = ""
    for w in words(text):
        if len(w) >= 4:
            yield w, before
            for n in STEMS:
                if len(w) > n:
                    yield w[:n] + "*", before
        before = w


def _count_terms(wanted):
    """Partial counts of terms: texts, and a bit set of the words before them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = wanted.value if wanted is not None else None
        for batch in batches:
            texts: Counter = Counter()
            around: dict[str, int] = {}
            for text in batch.column(0).to_pylist():
                mine: dict[str, int] = {}
                for term, before in _candidates(text):
                    if keep is None or term in keep:
                        mine[term] = mine.get(term, 0) | 1 << (zlib.crc32(before.encode()) % 62)
                texts.update(mine.keys())
                for term, bits in mine.items():
                    around[term] = around.get(term, 0) | bits
            yield pa.RecordBatch.from_pydict(
                {"term": list(texts), "texts": [texts[t] for t in texts],
                 "around": [around[t] for t in texts]},
                pa.schema([("term", pa.string()), ("texts", pa.int64()), ("around", pa.int64())]))
    return run


def own_right(toxic: int, clean: int, n_toxic: int, n_clean: int) -> bool:
    """Whether a form near a term is a word of its own: texts that hold it of all texts."""
    return clean > 0 and toxic * n_clean <= FORM_RATIO * clean * n_toxic


def mine_terms(spark: SparkSession, rows: DataFrame) -> tuple[dict[str, int], list[str]]:
    """Terms, with the toxic texts that hold each, and stems that toxic texts hold far more often.

    Only terms of enough toxic texts reach the driver, and each text has a bounded share in
    their number: the sum of their counts is at most the words of the training rows.
    """
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return {}, []
    schema = "term string, texts long, around long"
    counted = lambda y, wanted: rows.where(F.col("toxic") == y).select("text").mapInArrow(
        _count_terms(wanted), schema).groupBy("term").agg(
            F.sum("texts").alias("texts"), F.bit_or("around").alias("around"))
    toxic = {r["term"]: r["texts"] for r in counted(1, None).where(
        (F.col("texts") >= MIN_TEXTS) & (F.bit_count("around") >= MIN_TEXTS)).collect()}
    wanted = spark.sparkContext.broadcast(frozenset(toxic))
    clean = {r["term"]: r["texts"] for r in counted(0, wanted).collect()}
    good = {t for t, k in toxic.items()
            if (k / n[1]) > RATIO * (clean.get(t, 0) + 0.5) / (n[0] + 1.0)}
    # A stem earns its place by texts that no single longer term accounts for. The longer
    # terms it covers stay, as a stem allows no edits and they do.
    longest: dict[str, int] = {}
    for t in good:
        body = t.rstrip("*")
        for size in range(min(STEMS), len(body) + 1):
            key = body[:size]
            if key + "*" != t and (size < len(body) or not t.endswith("*")):
                longest[key] = max(longest.get(key, 0), toxic[t])
    stems: list[str] = []
    for s in sorted((t[:-1] for t in good if t.endswith("*")), key=lambda s: (len(s), s)):
        if toxic[s + "*"] >= STEM_GAIN * longest.get(s, 0) and not any(s.startswith(x) for x in stems):
            stems.append(s)
    return {t: toxic[t] for t in good if not t.endswith("*")}, stems


def misspelt(text: str, hits: set[str]) -> str:
    """The text with one letter changed in each hit of five letters or more, always the same one."""
    def change(m: re.Match) -> str:
        w = m.group()
        if len(w) < 5 or w.lower() not in hits:
            return w
        h = zlib.crc32(w.encode())
        i = 1 + h % (len(w) - 1)
        return w[:i] + chr(97 + (ord(w[i]) + 1 + h // 64 % 24) % 26) + w[i + 1:]
    return WORD.sub(change, text)


def fold(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) & 1


def allowed_edits(spark: SparkSession, rows: DataFrame, terms: dict[str, int], stems: list[str],
                  n: dict[int, int]) -> dict[str, int]:
    """Edits of the terms that allow fewer than their length does.

    A term keeps an edit while texts that hold it are so much likelier to be toxic than texts
    that hold a neighbour at that distance or nearer are to be clean.
    """
    shared = spark.sparkContext.broadcast((sorted(terms), stems))

    def run(batches):
        scanner = Scanner(*shared.value, [], set())
        for batch in batches:
            texts: Counter = Counter()
            for text in batch.column(0).to_pylist():
                met: dict[str, int] = {}
                for w in scanner.hits(text)[1]:
                    if scanner.forms[w] == "fuzzy":
                        for term, e in scanner.automaton.near(w):
                            met[term] = min(e, met.get(term, e))
                texts.update(met.items())
            yield pa.RecordBatch.from_pydict(
                {"term": [t for t, _ in texts], "edits": [e for _, e in texts], "texts": list(texts.values())},
                pa.schema([("term", pa.string()), ("edits", pa.int64()), ("texts", pa.int64())]))

    clean: dict[str, Counter] = {}
    for r in rows.where("toxic = 0").select("text").mapInArrow(
            run, "term string, edits long, texts long").groupBy("term", "edits").agg(
            F.sum("texts").alias("texts")).collect():  # at most two rows a term
        clean.setdefault(r["term"], Counter())[r["edits"]] = r["texts"]
    edits = {}
    for t, near in clean.items():
        share = max(terms[t], MIN_TEXTS) / max(n.get(1, 0), 1)
        for e in range(1, allowed(t) + 1):
            held = sum(k for at, k in near.items() if at <= e)
            if share <= NEAR_RATIO * (held + 0.5) / (n.get(0, 0) + 1.0):
                edits[t] = e - 1
                break
    return edits


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame,
        max_labelled: int = MAX_LABELLED, steps: int = 400) -> Model:
    """Lexicon, exceptions and weights from the labelled texts; without any, the prior model."""
    rows = training_rows(docs, labels, max_labelled).persist()
    try:
        mined, stems = mine_terms(spark, rows)
        counted = {**dict.fromkeys(SEED_TERMS, 0), **mined}
        terms = sorted(counted)
        n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
        edits = allowed_edits(spark, rows, counted, stems, n)
        scan = spark.sparkContext.broadcast((terms, stems, edits))

        def near(batches):
            """Forms that are only near a term, with the toxic and the clean texts of each half."""
            terms, stems, edits = scan.value
            scanner = Scanner(terms, stems, [], set(), edits)
            for batch in batches:
                texts: dict[str, list[int]] = {}
                for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                    for w in scanner.hits(text)[1]:
                        if scanner.forms[w] == "fuzzy":
                            texts.setdefault(w, [0] * 4)[2 * fold(text) + 1 - toxic] += 1
                yield pa.RecordBatch.from_pydict(
                    {"form": list(texts), **{c: [x[i] for x in texts.values()]
                                             for i, c in enumerate(("toxic0", "clean0", "toxic1", "clean1"))}},
                    pa.schema([("form", pa.string()), *[(c, pa.int64()) for c in (
                        "toxic0", "clean0", "toxic1", "clean1")]]))

        sums = [F.sum(c).alias(c) for c in ("toxic0", "clean0", "toxic1", "clean1")]
        forms = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(
            near, "form string, toxic0 long, clean0 long, toxic1 long, clean1 long").groupBy("form").agg(
            *sums).where("clean0 + clean1 > 0").collect()
        known = lambda toxic, clean: {
            r["form"] for r in forms if own_right(sum(r[c] for c in toxic), sum(r[c] for c in clean),
                                                  n.get(1, 0), n.get(0, 0))}
        exceptions = known(("toxic0", "toxic1"), ("clean0", "clean1"))
        model = Model(terms, stems, exceptions, PRIOR, edits)
        # A text is looked at as one not seen before: by what the other half showed.
        halves = (known(("toxic1",), ("clean1",)), known(("toxic0",), ("clean0",)))
        shared = spark.sparkContext.broadcast(halves)

        def featured(batches):
            terms, stems, edits = scan.value
            scanners = [Scanner(terms, stems, [], held, edits) for held in shared.value]
            for batch in batches:
                seen, label = [], []
                for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                    scanner = scanners[fold(text)]
                    seen.append(scanner.features(text))
                    label.append(toxic)
                    hits = scanner.hits(text)[1] if toxic else None
                    if hits:
                        seen.append(scanner.features(misspelt(text, hits)))
                        label.append(toxic)
                yield pa.RecordBatch.from_pydict(
                    {"f": seen, "toxic": label},
                    pa.schema([("f", pa.list_(pa.float64())), ("toxic", pa.float64())]))

        data = rows.select("text", F.col("toxic").cast("double").alias("toxic")).mapInArrow(
            featured, "f array<double>, toxic double").collect()
    finally:
        rows.unpersist()
    if data:
        weights = fit_weights(np.array([[*r["f"], 1.0] for r in data]),
                              np.array([r["toxic"] for r in data]), steps)
        model = Model(terms, stems, exceptions, weights, edits)
    return model


def fit_weights(x: np.ndarray, y: np.ndarray, steps: int) -> np.ndarray:
    """Logistic weights by Newton's method, drawn to the prior; a misspelt hit never speaks for a text."""
    free = np.ones(x.shape[1], bool)
    weights = PRIOR.copy()
    fuzzy = FEATURES.index("fuzzy")
    while True:
        for _ in range(steps):  # a few suffice
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            gradient = x.T @ (p - y) + 0.5 * (weights - PRIOR)
            curve = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(weights))
            step = np.zeros(len(weights))
            step[free] = np.linalg.solve(curve[np.ix_(free, free)], gradient[free])
            weights = weights - step
            if np.abs(step).max() < 1e-8:
                break
        if weights[fuzzy] >= 0 or not free[fuzzy]:
            return weights
        weights, free[fuzzy] = PRIOR.copy(), False
        weights[fuzzy] = 0.0


def score_texts(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for every row of ``docs``, 0 to 1.

    Null counts as an empty text, which has no hits and the lowest score. Repeated rows give
    repeated rows; columns other than ``doc_id`` and ``text`` are not read.
    """
    docs = docs.select("doc_id", "text")
    shared = spark.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        scanner = model.scanner()
        for batch in batches:
            scores = model.scores(scanner, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, score double")


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row; learns from rows not held out only.

    Null counts as an empty text, which has the lowest score, and every text is read whole.
    Repeated rows give repeated rows, a row without an id is not held out, equal texts have equal
    scores. ``labels`` without usable rows leave the prior model; columns other than ``doc_id``,
    ``text`` and ``toxic`` are not read.
    """
    scored = score_texts(spark, docs, fit(spark, docs, labels, **options))
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows scored 0.5 or more; the decision is per row, on its text."""
    shared = spark.sparkContext.broadcast(fit(spark, docs, labels, **options).parts())
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        scanner = model.scanner()
        for batch in batches:
            scores = model.scores(scanner, batch.column(text_at).to_pylist())
            yield batch.filter(pa.array(scores < 0.5))

    return docs.mapInArrow(run, docs.schema)
