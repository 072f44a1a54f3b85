"""Exact deduplication by distributed most-significant-digit radix partitioning.

The first digit of a text is its byte length with its first bytes; every later digit is a
longer stretch of the bytes that follow. At each level only the groups that still hold more
than one row go on; a group whose rows are used up is a group of equal texts. Rows are told
apart by comparing bytes, never digests.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Bytes consumed by each level; the last width repeats until the longest text is used up.
DIGIT_WIDTHS = (64, 4096, 65536, 1 << 20)


def normalised(text: Column) -> Column:
    """Null as empty; every run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, widths: Sequence[int] = DIGIT_WIDTHS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256; with ``carry`` also ``row``, a struct of all input columns.

    * Null text counts as empty; empty texts equal each other.
    * Of equal texts the row with the smallest id stays (a null id sorts first). Of rows that
      also repeat the id exactly one stays.
    * Extra columns, whatever their names, are ignored or carried inside ``row``.
    * An empty table gives an empty result.

    Scale: level 0 shuffles (length, 64 bytes) with map-side counts, then each text once. Hot
    groups are counted map-side and joined back through a skew-splittable join, so no task
    gathers a group (the merge hint keeps one plan at every size). Later levels see only rows that share length and prefix with another.
    """
    cols = [F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")]
    if carry:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest"))
    raw = normalised(F.col("text")).cast("binary")
    head = F.substring(raw, 1, widths[0])
    base = docs.select(*cols)

    first = base.select(F.octet_length(raw).alias("len"), head.alias("dig")).groupBy("len", "dig").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = written(first.select("len", "dig", F.monotonically_increasing_id().alias("g")), "radix-groups")
    keyed = base.withColumns({"len": F.octet_length(raw), "dig": head, "sha": F.sha2(raw, 256)})
    met = keyed.alias("l").join(groups.hint("merge").alias("r"), (F.col("l.len") == F.col("r.len")) & (F.col("l.dig") == F.col("r.dig")), "left")
    rest = ["rest"] if carry else []
    text = F.col("text") if carry else F.when(F.col("g").isNotNull(), F.col("text"))
    level = written(met.select("id", F.monotonically_increasing_id().alias("rid"), F.col("l.len").alias("len"), "sha", "g", text.alias("text"), *rest), "radix-0")
    discard(groups)

    def resolved(df: DataFrame) -> DataFrame:
        return df.select("id", "sha", "keep_id", "n", "kept", *(["text", "rest"] if carry else []))

    out = resolved(level.filter("g IS NULL").withColumns({"keep_id": F.col("id"), "n": F.lit(1).cast("long"), "kept": F.lit(True)}))
    open_rows, at, depth = level.filter("g IS NOT NULL"), widths[0], 1
    while not open_rows.isEmpty():
        width = widths[min(depth, len(widths) - 1)]
        digit = F.substring(raw, at + 1, width)
        keyed = open_rows.withColumn("dig", digit)
        found = keyed.groupBy("g", "dig").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "rid")).alias("best")).filter("n > 1")
        groups = written(found.select(F.col("g").alias("g0"), F.col("dig").alias("dig0"), "n", "best", F.monotonically_increasing_id().alias("g1")), "radix-groups")
        met = keyed.join(groups.hint("merge"), (F.col("g") == F.col("g0")) & (F.col("dig") == F.col("dig0")), "left")
        ended = F.col("len") <= at + width
        more = F.col("g1").isNotNull() & ~ended
        keep = F.when(F.col("g1").isNull(), F.struct("id", "rid")).otherwise(F.col("best"))
        step = met.select(
            "id", "rid", "len", "sha",
            F.when(more, F.col("g1")).alias("g"),
            (F.col("text") if carry else F.when(more, F.col("text"))).alias("text"),
            keep["id"].alias("keep_id"),
            F.coalesce("n", F.lit(1).cast("long")).alias("n"),
            (F.col("rid") == keep["rid"]).alias("kept"),
            *rest,
        )
        level = written(step, f"radix-{depth}")
        discard(groups)
        out = out.unionByName(resolved(level.filter("g IS NULL")))
        open_rows, at, depth = level.filter("g IS NOT NULL").drop("keep_id", "n", "kept"), at + width, depth + 1

    cols = [F.col("id").alias(id_col), F.col("keep_id"), F.col("n").alias("group_size"), "kept", F.col("sha").alias("text_sha256")]
    if carry:
        fields = [F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
        cols.append(F.struct(*fields).alias("row"))
    return out.select(*cols)


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n"""
