"""Character statistics of a string column, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlwarden import fixed_values as V


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literals(values: list[str]) -> Column:
    """A constant array of strings, built as one expression."""
    return F.expr(f"array({', '.join(map(quoted, values))})")


def unnest(df: DataFrame, keep: list[str], array: Column | str, name: str,
           pos: str | None = None) -> DataFrame:
    """One row per array element.

    The outer form with a filter on its result: from the inner form the planner derives a
    filter on the array size and pushes a copy of the whole array expression below the rows.
    """
    made = F.posexplode_outer(array).alias(pos, name) if pos else F.explode_outer(array).alias(name)
    return df.select(*keep, made).where(F.col(name).isNotNull())


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(V.WHITESPACE))


def entropy(text: Column, length: Column) -> Column:
    """Shannon bits per character; 0 for an empty string.

    Pass plain columns: both are read once per distinct character. A character is
    counted by the bytes its removal takes away, so the loop is over the alphabet
    of the string and not over the string.
    """
    size = F.octet_length(text)
    counts = F.transform(
        F.array_distinct(F.split(text, "")),
        lambda ch: (size - F.octet_length(F.replace(text, ch, F.lit("")))) / F.octet_length(ch))
    total = F.aggregate(counts, F.lit(0.0), lambda acc, n: acc + n * F.log2(n))
    return F.when(length > 0, F.greatest(F.lit(0.0), F.log2(length) - total / length)).otherwise(0.0)


def share(count: Column, length: Column) -> Column:
    return F.when(length > 0, count / length).otherwise(0.0)


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def count_digits(text: Column, length: Column) -> Column:
    """Digit characters; the short pattern is enough where every character is one byte."""
    return F.when(F.octet_length(text) == length, count_matches(text, "[0-9]")).otherwise(
        count_matches(text, V.DIGIT))


def text_features(df, text: str):
    """Entropy, length and the digit, special and upper-case shares of free text (5 dp)."""
    df = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("char_length", F.length("_text"))
    t, n = F.col("_text"), F.col("char_length")
    return df.withColumns({
        "shannon_entropy": F.round(entropy(t, n), 5),
        "digit_ratio": F.round(share(count_digits(t, n), n), 5),
        "special_char_ratio": F.round(share(count_matches(t, r"[^\p{L}\p{N}]"), n), 5),
        "uppercase_ratio": F.round(share(count_matches(t, r"\p{Lu}"), n), 5),
    }).drop("_text")
