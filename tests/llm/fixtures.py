"""Odd rows that every operator must take."""

LONG = "word " * 30_000 + "x" * 20_000
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from it", "en"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from it", "en"),
    (3, None, "en"), (4, "", None), (5, "   \t\n ", "de"), (6, LONG, "en"),
    (7, "short", "fr"), (7, "short", "fr"), (8, "emoji 😀 and é, ß, ñ — “quoted”", "es"),
    (None, "a row without an id", "en"), (9, "\n\n\n", "en"), (10, "\x00 control \x1b text", "en"),
]
#: Names that operators use for columns of their own.
CLASHES = ["key", "n", "line", "component", "keep_id", "block", "mask", "row", "base", "wide",
           "a", "b", "score", "kept", "text_sha256", "words", "at", "first"]


def odd_documents(spark):
    rows = [(i, t, lang, "s", len(t or ""), *["clash"] * len(CLASHES)) for i, t, lang in ODD]
    schema = ("doc_id long, text string, lang string, source string, n_chars long, "
              + ", ".join(f"{c} string" for c in CLASHES))
    return spark.createDataFrame(rows, schema)


def plain(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")
