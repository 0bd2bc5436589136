"""Rows that every operator must bear."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType())
    ]
)

#: Nulls, empty and white texts, ties, repeated rows, a very long text, no spaces at all, wide characters, special tokens.
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 4), (4, "one two three", "en", "a", 13), (5, "One  two\nthree", "en", "b", 13),
    (
        6,
        "the of and to in is that it for as was with be by on are " * 6,
        "en",
        "b",
        0
    ), (6, "the of and to in is that it for as was with be by on are " * 6, "en", "b", 0),
    (None, "a row without a key", "en", "c", 0), (7, "x" * 5000, "de", "c", 0), (8, "é　ñ 中文 😀 ́ <|endoftext|> <|ENDOFTEXT|>", "fr", "c", 0),
    (9, "line\nline\n\nline\nother", None, "c", 0), (
        10,
        " ".join(f"w{k % 977}" for k in range(40_000)),
        "en",
        "a",
        0
    ), (11, "12 34 !? $$$ ###", "en", "a", 0), (-5, "0 0 0 0 0 0 0 0", "es", "a", 0),
]


