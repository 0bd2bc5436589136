"""Quality rules: a table of thresholds compiled into one Spark projection.

No user functions: counts come from built-in string and array functions, so the
whole operator is a narrow projection without a shuffle. A null or empty text has
counts of zero and fails the base rule on words. Rows are judged alone: ties,
repeated rows, other columns and their names don't matter. Very long texts are counted whole; an empty table gives one.

Words are runs of characters other than 0x20 and 0x09-0x0D. Windows of three words
are compared by a 64-bit hash with the next in sorted order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"

#: Common words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that it for as was with be by on are this at an a or from not have has he she his you they we"
    " der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über"
    " de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son elle mais comme nous"
    " el que y los del se las por un con no una su al lo para como más pero sus le ya este sí porque esta entre cuando muy sin sobre también"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a document if ``low <= measure <= high``; a missing bound doesn't bind."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The method's own table; the base rules stand beside it.
RULES = (
    Rule("mean_word_length", 1.5, 20.0),
    Rule("symbol_ratio", None, 0.10),
    Rule("dup_line_ratio", None, 0.50),
    Rule("stop_word_ratio", 0.005, None),
    Rule("long_word_ratio", None, 0.30),
)
MIN_WORDS, REPEAT_PERCENT = 50, 50


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column) -> Column:
    """Words that lie in windows of three words found twice or more in the text."""

    def gather(sorted_windows: Column) -> Column:
        n = F.size(sorted_windows)

        def again(w: Column, i: Column) -> Column:
            h = w["h"]
            return (F.get(sorted_windows, i - 1)["h"].eqNullSafe(h)) | (F.get(sorted_windows, i + 1)["h"].eqNullSafe(h))

        places = F.array_sort(F.transform(F.filter(sorted_windows, again), lambda w: w["i"]))
        covered = F.aggregate(
            places,
            F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-3).cast("long").alias("last")),
            lambda acc, p: F.struct((acc["sum"] + F.least(F.lit(3).cast("long"), p - acc["last"])).alias("sum"), p.alias("last")),
            lambda acc: acc["sum"],
        )
        return F.when(n > 1, covered).otherwise(F.lit(0).cast("long"))

    def of(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(1), F.size(w) - 2),
            lambda i: F.struct(F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("h"), i.cast("long").alias("i")),
        )
        return F.when(F.size(w) >= 4, let(F.sort_array(windows), gather)).otherwise(F.lit(0).cast("long"))

    return let(words, of)


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a struct column __m of the counts of each text."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "")
    low = [w for w in dict.fromkeys(STOP_WORDS)]
    counts = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(low))).cast("long").alias("n_stop_words"),
            F.size(F.filter(w, lambda x: F.length(x) > 40)).cast("long").alias("n_long_words"),
        ),
    )
    line_counts = let(
        lines,
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    )
    return df.withColumn(
        "__m",
        F.struct(
            counts.alias("w"),
            line_counts.alias("l"),
            F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(t, SYMBOLS, "")).cast("long").alias("n_symbols"),
        ),
    )


MEASURES = {
    "mean_word_length": "__m.word_chars / __m.w.n_words",
    "symbol_ratio": "__m.n_symbols / __m.word_chars",
    "dup_line_ratio": "__m.l.n_dup_lines / __m.l.n_lines",
    "stop_word_ratio": "__m.w.n_stop_words / __m.w.n_words",
    "long_word_ratio": "__m.w.n_long_words / __m.w.n_words",
}


def compiled(rules: tuple[Rule, ...] = RULES) -> str:
    """SQL of the method's verdict over the counts; ratios of nothing don't fail."""
    tests = []
    for r in rules:
        over, under = MEASURES[r.measure].split(" / ")
        if r.low is not None:
            tests.append(f"{over} >= {r.low} * {under}")
        if r.high is not None:
            tests.append(f"{over} <= {r.high} * {under}")
    return " and ".join(tests) or "true"


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept, which replace columns of these names."""
    base = f"__m.w.n_words < {MIN_WORDS} or 100 * __m.w.n_repeat_words > {REPEAT_PERCENT} * __m.w.n_words"
    names = {
        "n_words": "__m.w.n_words", "word_chars": "__m.word_chars", "n_symbols": "__m.n_symbols", "n_dup_lines": "__m.l.n_dup_lines",
        "n_repeat_words": "__m.w.n_repeat_words", "base_failed": base, "kept": f"not ({base}) and {compiled(rules)}",
    }
    return measured(df, text).withColumns({k: F.expr(v) for k, v in names.items()}).drop("__m")


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB's SQL, by way of rows of words and windows."""
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    verdict = compiled(rules).replace("__m.w.", "").replace("__m.l.", "").replace("__m.", "")
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d)),
    g AS (SELECT r, i, word, lead(word) OVER p AS w2, lead(word, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
    k AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, w2, w3) AS n FROM g WHERE w3 IS NOT NULL),
    c AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM k, (VALUES (0), (1), (2)) AS v(o) WHERE n > 1 GROUP BY r),
    s AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars,
                 count(*) FILTER (lower(word) IN ({stops})) AS n_stop_words, count(*) FILTER (length(word) > 40) AS n_long_words FROM w GROUP BY r),
    l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
          FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
    a AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
                 length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                 coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                 coalesce(n_stop_words, 0) AS n_stop_words, coalesce(n_long_words, 0) AS n_long_words
          FROM d LEFT JOIN s USING (r) LEFT JOIN l USING (r) LEFT JOIN c USING (r)),
    b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM a)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
           n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND ({verdict}) AS kept FROM b"""
