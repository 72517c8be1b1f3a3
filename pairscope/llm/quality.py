"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.llm.common import packed, read

#: Frequent function words of the languages the rules know.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "are", "with", "be", "at", "by", "this", "from", "or"],
    "fr": ["le", "la", "les", "de", "des", "et", "un", "une", "du", "en", "est", "que", "qui", "dans", "pour", "par", "sur", "au", "avec", "ou"],
    "de": ["der", "die", "das", "und", "in", "zu", "den", "von", "mit", "ist", "nicht", "ein", "eine", "dem", "des", "im", "auf", "sich", "es", "auch"],
    "es": ["el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "se", "no", "por", "con", "para", "es", "al", "lo", "su", "como"],
}

#: (measure, least, most): a text fails if a measure lies outside; None: open.
RULES: list[tuple[str, float | None, float | None]] = [
    ("mean_word_length", 1.5, 25.0),
    ("symbol_ratio", None, 0.10),
    ("dup_line_ratio", None, 0.50),
    ("stop_word_ratio", 0.005, None),
    ("longest_word", None, 1000.0),
]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def repeated_words(hashes: Column, window: int = 5) -> Column:
    """Words that lie in a window found twice or more, the first included; hashes: one long a word.

    Windows are told apart by a 64-bit hash. A text without repeats costs a hash set; only others are sorted.
    """

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(places, i + 1) - p, F.lit(window))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)

    def places(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda p, j: (F.coalesce(F.get(pairs, j - 1)["h"] == p["h"], F.lit(False))) | (F.coalesce(F.get(pairs, j + 1)["h"] == p["h"], F.lit(False))))
        return F.sort_array(F.transform(twice, lambda p: p["i"]))

    def bound(value: Column, f) -> Column:
        """f over value, which is worked out once."""
        return F.transform(F.array(value), f)[0]

    def of_windows(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(bound(pairs, lambda p: bound(places(p), covered)))

    def of_hashes(h: Column) -> Column:
        starts = F.slice(h, 1, F.size(h) - (window - 1))
        windows = F.transform(starts, lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, window))))
        return F.when(F.size(h) <= window, F.lit(0).cast("bigint")).otherwise(bound(windows, of_windows))

    return bound(hashes, of_hashes)


def measures(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with the counts and ratios the rules look at; keep: columns to carry (all but text's copies by default)."""
    keep = keep if keep is not None else docs.columns
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(body, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(body, r"\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select(*(F.col(c) for c in keep), body.alias("__body"), words.alias("__words"), lines.alias("__lines"))
    second = first.select(*keep, "__body", "__words", "__lines", F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"))
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    return second.select(
        *keep,
        F.size("__words").cast("bigint").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("__body", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("__lines").cast("bigint").alias("n_lines"),
        repeated_words(F.col("__hashes")).alias("n_repeat_words"),
        F.size(F.filter("__words", lambda w: F.lower(w).isin(*stop))).cast("bigint").alias("n_stop_words"),
        F.coalesce(F.array_max(F.transform("__words", lambda w: F.length(w))), F.lit(0)).cast("bigint").alias("longest_word"),
    )


def verdict(rules: list[tuple[str, float | None, float | None]] = RULES) -> Column:
    """True where a row of measures() keeps to every rule of the table."""
    value = {
        "mean_word_length": _ratio(F.col("word_chars"), F.col("n_words")),
        "symbol_ratio": _ratio(F.col("n_symbols"), F.col("word_chars")),
        "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
        "stop_word_ratio": _ratio(F.col("n_stop_words"), F.col("n_words")),
        "longest_word": F.col("longest_word").cast("double"),
        "n_words": F.col("n_words").cast("double"),
    }
    out = F.lit(True)
    for name, least, most in rules:
        if least is not None:
            out = out & (value[name] >= least)
        if most is not None:
            out = out & (value[name] <= most)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def assess(docs: DataFrame, text: str = "text", key: str = "doc_id", rules=RULES) -> DataFrame:
    """One row a row of docs: key, counts, base_failed, kept.

    A null text counts as empty (0 words: fails); repeated rows each get a row; a null key stays null; columns other
    than key and text are not read; an empty table gives an empty result.
    """
    found = measures(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text", ["doc_id"])
    out = found.select(*found.columns, base_failed().alias("base_failed"))
    return out.select(*out.columns, (~F.col("base_failed") & verdict(rules)).alias("kept"))


def filter_quality(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of docs that keep to the rules, with the columns of docs."""
    held = docs.select(packed(docs).alias("__row"), F.col(text).alias("text"))
    found = measures(held, "text", ["__row"])
    return found.filter(~base_failed() & verdict(rules)).select("__row.*")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assess(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines", "longest_word")


def op5_sql(rules: list[tuple[str, float | None, float | None]] = RULES) -> str:
    """The rows of op5 in SQL, over the same threshold table."""
    value = {
        "mean_word_length": "coalesce(word_chars / nullif(n_words, 0), 0)",
        "symbol_ratio": "coalesce(n_symbols / nullif(word_chars, 0), 0)",
        "dup_line_ratio": "coalesce(n_dup_lines / nullif(n_lines, 0), 0)",
        "stop_word_ratio": "coalesce(n_stop_words / nullif(n_words, 0), 0)",
        "longest_word": "longest_word",
        "n_words": "n_words",
    }
    bounds = [f"{value[n]} >= {lo}" for n, lo, _ in rules if lo is not None] + [f"{value[n]} <= {hi}" for n, _, hi in rules if hi is not None]
    stop = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    return rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) AS ls FROM documents
), g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4] AS win FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w) x
), r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) y, (SELECT unnest(generate_series(0, 4)) AS k) z WHERE c > 1 GROUP BY doc_id
), m AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS n_stop_words, len(ls) AS n_lines, coalesce(list_max(list_transform(ws, lambda x: length(x))), 0) AS longest_word
  FROM w LEFT JOIN r USING (doc_id)
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {" AND ".join(bounds)} AS kept FROM b
"""
