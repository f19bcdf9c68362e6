"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, odd characters, clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997} the and" for i in range(12_000))
TEXTS = [
    None, "", " ", "\n\n", "a", "The quick brown fox jumps over the lazy dog.\nAll rights reserved.", "The quick brown fox jumps over the lazy dog.\nAll rights reserved.",
    "  All Rights Reserved.\t\nsecond line here", LONG, "tab\tand\x0bother\x0cspace\r\nend", "日本語 テキスト 🙂 ÀÉ é", "<|endoftext|> x <|endoftext|>", "it's we'll  don't\n\n  x", "1 2 3 4 5 6 7 8 1 2 3 4 5 6 7 8", "word " * 40,
]


def documents(spark, more=()):
    """The odd rows, with a null and a repeated doc_id, and columns named like those that operators add."""
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate([*TEXTS, *more])]
    rows += [(None, "no id", None, None, None), (5, TEXTS[5], "en", "s", 1)]
    names = ["kept", "score", "n_words", "fp", "key", "digest", "_fw_place", "length", "sequence_id"]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in names})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
