"""Small documents tables with what operators must bear: nulls, empty and long texts, repeats, clashing columns."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("n_tokens", "ids", "size", "shard", "id", "key", "words", "norm", "block", "score", "place", "component_id", "kept", "host", "content", "hashes", "language", "pattern")

ROWS = [
    (0, "The quick brown fox jumps over the lazy dog. It is released under the MIT License, and that is all.", "en", "a", 0),
    (1, "", "en", "a", 0),
    (2, None, "en", "a", 0),
    (3, "   \n\t ", None, "a", 0),
    (4, "Été où l'élève naïf — ça va? " * 40, "fr", "b", 0),
    (5, "lorem ipsum dolor sit amet " * 9000, "en", "b", 0),
    (6, "漢字かな交じり文。 🙂👩‍👩‍👧 mixed <|endoftext|> special", None, None, None),
    (7, "x" * 70_000, "de", "c", 0),
    (8, "The quick brown fox jumps over the lazy dog. It is released under the MIT License, and that is all.", "en", "a", 0),
    (8, "The quick brown fox jumps over the lazy dog. It is released under the MIT License, and that is all.", "en", "a", 0),
    (None, "no id here but some text", "en", "a", 0),
    (9, "a b", "en", "a", 0),
    (10, "Licensed under the Apache License, Version 2.0. See CC BY-NC 4.0 too.", "en", "a", 0),
]


def odd(spark):
    """The rows above, with more columns whose names the operators use inside."""
    frame = spark.createDataFrame(ROWS, SCHEMA)
    return frame.withColumns({name: F.lit("clash") for name in CLASHES})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
