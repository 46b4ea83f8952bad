"""Projection, cleaning and filter operators (FLT-1..8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanalign.functions.text import n_bytes, non_blank, normalize_language as _norm


def drop_blank(df: DataFrame, text: str = "text") -> DataFrame:
    """Drop null, empty and whitespace-only texts."""
    return df.filter(non_blank(text))


def normalize_language(df: DataFrame, col: str = "grp", aliases: dict | None = None,
                       out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, _norm(col, aliases))


def keep_languages(df: DataFrame, languages, col: str = "grp") -> DataFrame:
    """Allow-list; rows with unknown (null) groups are dropped too. A Python
    list becomes an ``isin`` literal; a DataFrame of allowed names becomes a
    left-semi join whose build side AQE broadcasts only when its measured
    size is below spark.sql.adaptive.autoBroadcastJoinThreshold."""
    if isinstance(languages, DataFrame):
        allowed = languages.select(F.col(languages.columns[0]).alias("_allowed")).distinct()
        return df.join(allowed, F.col(col) == F.col("_allowed"), "left_semi")
    return df.filter(F.col(col).isin(list(languages)))


def within_bytes(text: str, limit: int):
    """True for texts whose UTF-8 size is at most ``limit``, false for others
    and for null."""
    return F.coalesce(n_bytes(text) <= F.lit(limit), F.lit(False))


def max_bytes(df: DataFrame, limit: int = 1 << 20, text: str = "text") -> DataFrame:
    """Keep texts whose UTF-8 size is at most ``limit`` (drop when > limit)."""
    return df.filter(within_bytes(text, limit))


def limit_accepted(df: DataFrame, n: int, order_by: str = "doc_id") -> DataFrame:
    """The first n rows that passed every filter, in a stable order."""
    return df.orderBy(order_by).limit(n)


def only_unaligned(detail: DataFrame) -> DataFrame:
    return detail.filter(~F.col("fully_aligned"))


def only_imperfect(scores: DataFrame) -> DataFrame:
    return scores.filter(~F.col("is_perfect"))


def quarantine(df: DataFrame, text: str = "text", group: str = "grp", max_size: int = 1 << 20,
               max_pieces: int | None = None, allowed=None) -> DataFrame:
    """Attach a rejection reason instead of silently dropping rows.

    Reasons in priority order: blank, unknown_language, oversize (UTF-8 bytes
    > max_size), too_many_pieces (a cost guard that replaces per-file
    timeouts), not_allowed. ``reason`` is null for accepted rows."""
    t = F.col(text)
    r = (F.when(~non_blank(t), F.lit("blank"))
         .when(F.col(group).isNull(), F.lit("unknown_language"))
         .when(n_bytes(t) > F.lit(max_size), F.lit("oversize")))
    if max_pieces is not None:
        from spanalign.functions.patterns import TOKEN_SCHEMES
        r = r.when(F.regexp_count(t, F.lit(TOKEN_SCHEMES["word"])) > F.lit(max_pieces), F.lit("too_many_pieces"))
    if allowed is not None:
        r = r.when(~F.col(group).isin(list(allowed)), F.lit("not_allowed"))
    return df.withColumn("reason", r)


def accepted(q: DataFrame) -> DataFrame:
    return q.filter(F.col("reason").isNull()).drop("reason")


def rejected(q: DataFrame) -> DataFrame:
    return q.filter(F.col("reason").isNotNull())
