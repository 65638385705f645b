"""Line deduplication: exact copies by hash, near copies by a segment-partition edit join.

Two lines within ``t`` edits share a segment: cut the shorter into t + 1 segments and one of
them occurs unchanged in the other, at a place that the two lengths bound (PassJoin). A line
posts its own segments under (length, segment number, content) and probes, for each length up
to t below its own, the substrings that may hold a segment. Keys where two different lines
meet give the candidates; a banded bit-parallel edit distance decides.

Only hashes of keys are shuffled. Keys that two lines share become a bounded blocked Bloom
filter, through which a second scan lets pass the few lines that can have a near copy, with
their text. Under keys of many lines no pairs are made: blocks of lines meet block by block.
Everything is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polderlake.llm.common import BLANKS, power_of_two, staged, text_or_empty

EDITS = 2
MIN_CHARS = 20  # shorter lines stay
MIN_NEAR_CHARS = 40  # shorter lines are compared for equality only
#: Options under which every line with a letter or digit takes part and a tenth of its length
#: may differ: 2 edits from 20 characters, 1 from 10, copies only below.
EVERY_LINE = {"min_chars": 1, "min_near_chars": 20, "short_chars": 10}
MAX_CHARS = 2 ** 31 - 1  # of a text in Spark
BLOCK_LINES = 64
MAX_FILTER_BLOCKS = 1 << 20  # 8 MB of filter words


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id, line_no, line`` of the lines that take part, blanks squeezed and trimmed."""
    def squeezed(line: Column) -> Column:
        # Most lines hold single spaces only, and finding that out is cheaper than squeezing.
        odd = F.lit(False)
        for c in ("  ", "\t", "\x0b", "\f", "\r"):
            odd = odd | F.contains(line, F.lit(c))
        return F.trim(F.when(odd, F.regexp_replace(line, BLANKS, " ")).otherwise(line))

    # Squeezed before they are rows: the conditions below would each squeeze them again.
    each = docs.where("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.transform(
        F.split(text_or_empty(), "\n", -1), squeezed)).alias("line_no", "line"))
    # Short lines of marks only are structure: rules, brackets, bullets.
    return each.where(
        (F.length("line") >= min_chars)
        & ((F.length("line") >= MIN_CHARS) | F.col("line").rlike(r"[\p{L}\p{N}]")))


def _hashes() -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")]


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) of the substrings to probe, own places left out.

    Of a segment with i before it and j after it, at most i edits lie before the first match
    and j after it, which bounds how far it can have moved.
    """
    found = []
    for d in range(edits + 1):
        for i in range(edits + 1):
            j = edits - i
            for shift in range(max(-i, d - j), min(i, d + j) + 1):
                if (d, shift) != (0, 0):
                    found.append((d, i, shift))
    return found


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


class SegmentKeys:
    """Keys of lines, as rows or as an array; see ``segment_keys``.

    As rows, a line meets a table of places, and one short expression cuts and hashes each: Spark
    compiles that, while a function of array elements is interpreted, and all places spelt out
    are a method too long for the JVM to compile. Characters are cut at four bytes each, as
    finding one in UTF-8 reads all before it.
    """

    def __init__(self, classes: list[tuple[int, int, int]]):
        self.places = F.array(*[
            F.struct(F.lit(least).alias("least"), F.lit(most).alias("most"), F.lit(edits + 1).alias("parts"),
                     F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(4 * shift + 1).alias("shift"),
                     F.lit(16 * -d + 4 * edits + i).alias("tag"), F.lit((d, shift) == (0, 0)).alias("posted"))
            for edits, least, most in classes
            for d, i, shift in [(0, i, 0) for i in range(edits + 1)] + probes(edits)])

    @staticmethod
    def _code() -> Column:
        return F.coalesce(F.encode("line", "UTF-32"), F.lit(b""))

    @staticmethod
    def _key(code: Column, n: Column, place: Column) -> Column:
        """The lowest bit is clear."""
        # Where segments i and i + 1 of a line that is d shorter begin.
        start, end = (F.floor((n - place["d"]) * (place["i"] + k) / place["parts"]).cast("int") * 4 for k in (0, 1))
        piece = F.substring(code, start + place["shift"], end - start)
        return F.xxhash64(n * 16 + place["tag"], piece).bitwiseAND(F.lit(-2).cast("long"))

    def rows(self, lines: DataFrame) -> DataFrame:
        """``lines`` with ``key`` and ``posted``, one row for each key of a line."""
        code, place = F.col("__code"), F.col("__place")
        n = F.shiftright(F.length(code), 2)
        each = lines.withColumn("__code", self._code()).select("*", F.explode(self.places).alias("__place"))
        return each.where(n.between(place["least"], place["most"])).select(
            *lines.columns, self._key(code, n, place).alias("key"), place["posted"].alias("posted"))

    def alias(self, name: str) -> Column:
        """The keys of a line as ``array<long>``, the lowest bit of a key set where the line posts it."""
        def keys(line: Column) -> Column:
            return F.transform(
                F.filter(self.places, lambda p: line["n"].between(p["least"], p["most"])),
                lambda p: self._key(line["code"], line["n"], p).bitwiseOR(p["posted"].cast("long")))

        return _let(self._code(), lambda code: _let(F.struct(
            code.alias("code"), F.shiftright(F.length(code), 2).alias("n")), keys)).alias(name)


def segment_keys(classes: list[tuple[int, int, int]]) -> SegmentKeys:
    """Keys of a line. Each class is (edits, least length, greatest length); a line has the keys
    of all that hold it."""
    return SegmentKeys(classes)


def _agreement(a: Column, b: Column, limit: Column, piece) -> Column:
    """The greatest length up to a limit at which pieces of both texts are equal, by bisection."""
    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        same = piece(a, middle) == piece(b, middle)
        return F.struct(F.when(same, middle).otherwise(s["low"]).alias("low"),
                        F.when(same, s["high"]).otherwise(middle - 1).alias("high"))

    rounds = F.ceil(F.log2(limit + 2)).cast("int")
    start = F.struct(F.lit(0).alias("low"), limit.cast("int").alias("high"))
    return F.aggregate(F.sequence(F.lit(1), rounds), start, step, lambda s: s["low"])


def differing(a: Column, b: Column, edits: int, body) -> Column:
    """``body`` of both texts without their common start and end, but ``edits`` + 1 letters."""
    shorter = F.least(F.length(a), F.length(b)) - (edits + 1)
    ends = lambda t, n: F.substring(t, F.length(t) - n + 1, n)
    starts = lambda t, n: F.substring(t, F.lit(1), n)
    limit = F.greatest(shorter, F.lit(0))
    return _let(_agreement(a, b, limit, starts), lambda head: _let(
        _agreement(a, b, limit - head, ends), lambda tail: body(*[
            F.substring(t, head + 1, F.length(t) - head - tail) for t in (a, b)])))


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two texts longer than ``edits`` are within so many edits (Hyyrö's banded form).

    Bit k of the band stands for row j - edits + k of column j. The lowest row of the band is
    followed down its diagonal until it reaches the last row, then along that row.
    """
    width = 2 * edits + 1
    mask = (1 << width) - 1
    long = lambda v: F.lit(v).cast("long")
    bit = lambda bits, k: F.shiftright(bits, k).bitwiseAND(long(1))
    flip = lambda bits: bits.bitwiseXOR(long(mask))
    chars = lambda t: F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0))

    def compare(x: Column, y: Column) -> Column:
        m, n = F.size(x), F.size(y)

        def step(s: Column, j: Column) -> Column:
            c = F.get(y, j - 1)
            same = long(0)
            for k in range(width):
                hit = F.coalesce(F.get(x, j - edits + k - 1) == c, F.lit(False))
                same = same.bitwiseOR(F.when(hit, long(1 << k)).otherwise(long(0)))

            def column(pm: Column) -> Column:
                vp, vn = s["vp"], s["vn"]
                d0 = (pm.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(pm).bitwiseOR(vn)
                return _let(d0.bitwiseAND(long(mask)), lambda d0: _let(
                    vn.bitwiseOR(flip(d0.bitwiseOR(vp))), lambda hp: _let(
                        d0.bitwiseAND(vp), lambda hn: F.struct(
                            hn.bitwiseOR(flip(F.shiftright(d0, 1).bitwiseOR(hp))).alias("vp"),
                            F.shiftright(d0, 1).bitwiseAND(hp).alias("vn"),
                            (s["far"] + F.when(j <= m - edits, 1 - bit(d0, 2 * edits)).otherwise(
                                F.call_function("shiftright", hp, m - j + edits).bitwiseAND(long(1))
                                - F.call_function("shiftright", hn, m - j + edits).bitwiseAND(long(1))
                            )).alias("far")))))

            # Down the diagonal the distance only grows, and each later column takes one off at
            # most: beyond this sum the columns that are left change nothing.
            return F.when(s["far"] > 2 * edits + n - m, s).otherwise(_let(same, column))

        start = F.struct(long(mask & ~((1 << edits) - 1)).alias("vp"), long(0).alias("vn"),
                         long(edits).alias("far"))
        return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["far"] <= edits)

    near = F.abs(F.length(a) - F.length(b)) <= edits
    return near & differing(a, b, edits, lambda a, b: _let(
        chars(a), lambda x: _let(chars(b), lambda y: compare(x, y))))


def letters_allow(a: Column, b: Column, edits: int | Column, letters: str = "aeinrst") -> Column:
    """False for texts that cannot be within so many edits, as a letter's counts differ by more."""
    count = lambda t, c: F.length(F.replace(t, F.lit(c), F.lit("")))
    allow = F.lit(True)
    for c in letters:  # the rest's length may differ by an edit of its own for each edit
        allow = allow & (F.abs((F.length(a) - count(a, c)) - (F.length(b) - count(b, c))) <= edits)
    return allow


def _mask(key: Column) -> Column:
    one = F.lit(1).cast("long")
    at = lambda shift: F.call_function(
        "shiftleft", one, F.shiftrightunsigned(key, shift).bitwiseAND(63).cast("int"))
    return at(58).bitwiseOR(at(52)).bitwiseOR(at(46))


def near_copies(spark: SparkSession, lines: DataFrame, classes: list[tuple[int, int, int]]) -> DataFrame:
    """``h1, h2`` of the lines that have an earlier, different line within the edits of a class.

    Each class is (edits, least length, greatest length), of both lines. Earlier is by first
    occurrence, ``(doc_id, line_no)``. Comparison is against all earlier lines, whether they stay
    or not.
    """
    keyed = segment_keys(classes).rows(lines.where(F.length("line") >= min(least for _, least, _ in classes)).select(
        "doc_id", "line_no", "line", *_hashes()))
    shared = staged(spark, keyed.groupBy("key").agg(
        F.min("h1").alias("low"), F.max("h1").alias("high"), F.max("posted").alias("posted"))
        .where("low != high AND posted").select("key"), "shared-keys")
    blocks = min(MAX_FILTER_BLOCKS, power_of_two(shared.count() / 4))
    block = F.pmod(F.shiftright("key", 1), F.lit(blocks))  # the lowest bit of a key is clear
    marks = staged(spark, shared.groupBy(block.alias("block")).agg(
        F.bit_or(_mask(F.col("key"))).alias("bits")), "shared-filter")
    passed = keyed.withColumn("block", block).join(F.broadcast(marks), "block").where(
        F.col("bits").bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key")))
    met = staged(spark, passed.groupBy("key", "posted", "h1", "h2").agg(
        F.min(F.struct("doc_id", "line_no")).alias("first"), F.any_value("line").alias("line"))
        .join(shared, "key", "left_semi"), "met-lines")

    # Few lines under a key are compared in pairs, many in blocks.
    size = staged(spark, met.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key-sizes")
    rows = met.join(size, "key")
    few, many = rows.where(F.col("n") <= BLOCK_LINES), rows.where(F.col("n") > BLOCK_LINES)
    # A pair may differ by the edits of the classes that hold both lines.
    both = lambda a, b: "greatest(0, " + ", ".join(
        f"if(length({a}) BETWEEN {least} AND {most} AND length({b}) BETWEEN {least} AND {most}, {edits}, 0)"
        for edits, least, most in classes) + ")"
    side = lambda df, p: df.select("key", *[F.col(c).alias(p + c) for c in
                                            ("posted", "h1", "h2", "first", "line")])
    pairs = side(few, "a_").join(side(few, "b_"), "key").where(
        "(a_posted OR b_posted) AND a_first < b_first AND NOT (a_h1 = b_h1 AND a_h2 = b_h2)"
        f" AND abs(length(a_line) - length(b_line)) <= {both('a_line', 'b_line')}")
    pairs = pairs.groupBy("a_h1", "a_h2", "b_h1", "b_h2").agg(
        F.any_value("a_line").alias("a_line"), F.any_value("b_line").alias("b_line"))
    a, b, near = F.col("a_line"), F.col("b_line"), F.lit(False)
    allowed = F.expr(both("a_line", "b_line"))
    for edits in sorted({edits for edits, _, _ in classes}):
        near = near | ((allowed == edits) & within(a, b, edits))
    in_pairs = pairs.where(letters_allow(a, b, allowed)).where(near).select(
        F.col("b_h1").alias("h1"), F.col("b_h2").alias("h2"))

    part = F.pmod("h2", F.ceil(F.col("n") / BLOCK_LINES))
    block_of = staged(spark, many.groupBy("key", part.alias("part")).agg(
        F.collect_list(F.struct("posted", "h1", "h2", "first", "line")).alias("some")), "line-blocks")
    meet = block_of.join(block_of.select("key", F.col("some").alias("others")), "key")
    in_blocks = meet.select(F.explode(F.expr(f"""filter(some, b -> exists(others, a ->
        (a.posted OR b.posted) AND a.first < b.first AND NOT (a.h1 = b.h1 AND a.h2 = b.h2)
        AND abs(length(a.line) - length(b.line)) <= {both('a.line', 'b.line')}
        AND levenshtein(a.line, b.line, {both('a.line', 'b.line')}) >= 0))""")).alias("b")).select("b.h1", "b.h2")
    return in_pairs.unionByName(in_blocks).distinct()


def dropped_lines(spark: SparkSession, docs: DataFrame, edits: int = EDITS,
                  min_chars: int = MIN_CHARS, min_near_chars: int = MIN_NEAR_CHARS,
                  short_chars: int | None = None) -> DataFrame:
    """``doc_id, dropped``: the numbers (from 0) of the lines each document loses.

    With ``short_chars`` two lines, the shorter of ``short_chars`` to ``min_near_chars``, are
    near copies within one edit.
    """
    docs = docs.select("doc_id", "text")
    lines = lines_of(docs, min_chars)
    classes = [(edits, min_near_chars, MAX_CHARS)]
    if short_chars is not None:
        classes.append((1, short_chars, min_near_chars))
    near = near_copies(spark, lines, classes)
    hashed = staged(spark, lines.select("doc_id", "line_no", *_hashes()), "line-hashes")
    copies = hashed.groupBy("h1", "h2").agg(
        F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n")).where("n > 1")
    verdicts = copies.select("h1", "h2", "first", F.lit(False).alias("near")).unionByName(
        near.select("h1", "h2", F.lit(None).cast(copies.schema["first"].dataType).alias("first"),
                    F.lit(True).alias("near"))).groupBy("h1", "h2").agg(
        F.max("first").alias("first"), F.max("near").alias("near"))
    verdicts = staged(spark, verdicts, "line-verdicts")
    gone = hashed.join(verdicts, ["h1", "h2"]).where(
        "near OR NOT (doc_id = first.doc_id AND line_no = first.line_no)")
    return staged(spark, gone.groupBy("doc_id").agg(
        F.collect_set("line_no").alias("dropped")), "dropped-lines")


def dedup_lines(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each line kept once: of equal and near equal lines, the first one.

    All rows and columns stay; ``text`` loses its repeated lines and ``n_chars``, where there
    is one, is counted anew where something was lost. The first occurrence is that of the
    smallest ``(doc_id, line_no)``. Lines compare with blanks squeezed and trimmed; those of
    under ``min_chars`` stay, those of under ``min_near_chars`` go for equality only or, from
    ``short_chars``, within one edit; short lines without a letter or digit stay. A null
    text stays null; rows without an id are left as they are and count for no other row; rows
    that share an id share its decisions.
    """
    gone = dropped_lines(spark, docs, **options).select(
        F.col("doc_id").alias("__doc_id"), F.col("dropped").alias("__dropped"))
    kept = F.expr("array_join(filter(split(text, '\\n', -1), "
                  "(x, i) -> NOT array_contains(__dropped, i)), '\\n')")
    out = docs.join(gone.hint("merge"), docs["doc_id"] == F.col("__doc_id"), "left")
    text = F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(kept)
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__dropped").isNull(), F.col("n_chars")).otherwise(
            F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(docs.columns)


def line_counts(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_lines, text_sha256, n_chars_kept`` per row, the last two of the text that stays."""
    left = dedup_lines(spark, docs.select("doc_id", "text", F.size(F.split(
        text_or_empty(), "\n", -1)).cast("long").alias("n_lines")), **options)
    text = text_or_empty()
    return left.select("doc_id", "n_lines", F.sha2(text, 256).alias("text_sha256"),
                       F.length(text).cast("long").alias("n_chars_kept"))
