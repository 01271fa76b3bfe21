"""Column-level functions on fixture columns.

All are built-in expressions (JVM side, inside whole-stage codegen); no Python
runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeeze_spaces(text) -> Column:
    """Whitespace runs to one space, trimmed."""
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def word_count(text) -> Column:
    s = squeeze_spaces(text)
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, " "))).cast("long")


def char_class_count(text, cls: str) -> Column:
    """Characters matching a one-character regex class, e.g. ``[A-Z]``."""
    return F.regexp_count(_c(text), F.lit(cls)).cast("long")


def text_features(df: DataFrame, col: str, prefix: str = "") -> DataFrame:
    """Length, words, lines, upper-case letters, digits and sentence ends."""
    t = F.col(col)
    return df.select(
        "*",
        F.length(t).cast("long").alias(f"{prefix}n_chars"),
        word_count(t).alias(f"{prefix}n_words"),
        (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long")
        .alias(f"{prefix}n_lines"),
        char_class_count(t, r"\p{Lu}").alias(f"{prefix}n_upper"),
        char_class_count(t, "[0-9]").alias(f"{prefix}n_digits"),
        char_class_count(t, "[.!?]").alias(f"{prefix}n_sentence_ends"),
    )


def json_field(col, path: str, type_: str) -> Column:
    """Typed field out of a JSON text column; null when absent or not convertible."""
    return F.get_json_object(_c(col), path).try_cast(type_)


def url_parts(df: DataFrame, col: str, prefix: str = "") -> DataFrame:
    """Scheme, host, path, query and fragment (``try_parse_url``: a malformed
    URL gives nulls instead of failing the job)."""
    u = F.col(col)
    parts = {"scheme": "PROTOCOL", "host": "HOST", "path": "PATH", "query": "QUERY",
             "fragment": "REF"}
    return df.select("*", *[F.try_parse_url(u, F.lit(p)).alias(f"{prefix}{n}") for n, p in parts.items()])


def dot(a, b) -> Column:
    """Dot product of two numeric arrays, accumulated in double."""
    prod = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def tokens(df: DataFrame, text: str, keep: list[str], lower: bool = True) -> DataFrame:
    """One row per whitespace-separated token with its 0-based position."""
    s = squeeze_spaces(text)
    if lower:
        s = F.lower(s)
    return (df.where(s != "")
              .select(*keep, F.posexplode(F.split(s, " ")).alias("pos", "token"))
              .withColumn("pos", F.col("pos").cast("long")))
