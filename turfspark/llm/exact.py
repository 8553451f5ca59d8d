"""Exact de-duplication by distributed MSD radix partitioning.

Texts are split into groups by their length and first bytes, then by ever longer runs of the following
bytes, until a group has one text or its texts have ended. No digest is compared: two texts are equal
when every run of their bytes fell into the same group. Each round is one aggregate with map-side
combining, so a group that holds a third of all rows costs one partial row per task, and only the
run of bytes in question is shuffled, never the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turfspark.llm import common

FIRST_BYTES = 32
GROWTH = 8
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Runs of white space become one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def groups(rows: DataFrame) -> DataFrame:
    """Groups of at least two rows with equal `body` (binary): row, head (struct of `first_id`), group_size."""
    row, size = common.ROW, F.octet_length("body")

    def digit(at: int, width: int) -> Column:
        return F.substring("body", at + 1, width).alias("digit")

    def split(members: DataFrame, *keys: str) -> DataFrame:
        """Members of groups of two or more after one more digit, with the new group as `gid`."""
        shared = common.cut(
            members.groupBy(*keys, "digit")
            .agg(F.min(common.first_id()).alias("head"), F.count(F.lit(1)).alias("group_size"))
            .where("group_size > 1")
        )
        columns = [F.col("m.doc_id"), F.col(f"m.{row}"), F.col("m.n")]
        same = [F.col(f"m.{k}") == F.col(f"s.{k}") for k in (*keys, "digit")]
        kept = members.alias("m").join(shared.alias("s"), same)
        return common.cut(kept.select(*columns, F.col(f"s.head.{row}").alias("gid"), "s.head", "s.group_size"))

    at = FIRST_BYTES
    found = split(rows.select("doc_id", row, size.alias("n"), digit(0, at)), "n")
    result = found.where(F.col("n") <= at)
    # the texts still in question, moved once; later rounds read runs of bytes from them
    bodies = common.stored(rows.where(size > at).select(row, "body").join(found.select(row), row))
    while True:
        alive = found.where(F.col("n") > at)
        if alive.isEmpty():
            return result.select(row, "head", "group_size")
        width = at * (GROWTH - 1)
        runs = bodies.where(size > at).select(row, digit(at, width))
        found = split(alive.select("doc_id", row, "n", "gid").join(runs, row), "gid")
        at += width
        result = result.union(found.where(F.col("n") <= at))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Equal means equal after each run of white space became one space; null counts as empty, and empty
    texts equal each other. Of equal texts the row with the smallest doc_id is kept; null ids come
    last, and of rows with the same id one stays. An empty table gives no rows. Other columns are not
    read. text_sha256 is only shown, never compared.
    """
    body = F.encode(normalised(F.col(f"`{text}`")), "UTF-8")
    rows = common.numbered(docs, doc_id=doc_id, body=body)
    shown = rows.select("doc_id", common.ROW, F.sha2("body", 256).alias("text_sha256"))
    joined = shown.join(groups(rows), common.ROW, "left")
    kept = F.col("head").isNull() | (F.col(f"head.{common.ROW}") == F.col(common.ROW))
    return joined.select(
        "doc_id",
        F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        kept.alias("kept"),
        "text_sha256",
    )
