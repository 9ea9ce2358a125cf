"""Exact dedup in three combining stages, DataFrame operations only.

Local: each task reduces equal texts to one row. Salted: rows of a digest from
different tasks meet under one of ``salts`` salts. Global: the salt winners
meet. Digest and whole content are the grouping key of every stage, so equal
digests never stand in for equal texts, and a text that fills a third of the
table reaches the last stage as at most ``salts`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, columns, stored

SALTS = 32


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def combined(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(digest, text, id) rows to one row per text: digest, text, keep, size."""
    salt = F.pmod(F.spark_partition_id(), F.lit(salts))
    salted = rows.select("digest", "text", "id", salt.alias("salt")).groupBy("digest", "text", "salt").agg(
        F.min("id").alias("keep"), F.count("*").alias("size"))
    return salted.repartition("digest").groupBy("digest", "text").agg(
        F.min("keep").alias("keep"), F.sum("size").alias("size"))


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", *, salts: int = SALTS,
                digest=sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of white space has
    become one space. Null texts count as empty, and empty texts form a group
    like any other. Null ids sort last, so such a row stays only in a group
    without any id. Of rows tied on the smallest id exactly one stays. An empty
    table gives no rows; other columns are ignored.
    """
    rows = columns(docs, id=id, text=text).select("id", normalised(F.col("text")).alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    # one row per digest; texts differ only where different texts share the digest
    groups = stored(combined(rows, salts).groupBy("digest").agg(
        F.count("*").alias("texts"), F.min("keep").alias("keep"), F.sum("size").alias("size")), "exact-groups")
    keys = stored(rows.select("id", "digest", F.monotonically_increasing_id().alias("row"),
                              *([] if digest is sha256 else [F.sha2("text", 256).alias("hex")])), "exact-keys")
    first = keys.groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).getField("row").alias("first"))
    single = groups.where("texts = 1").select("digest", "keep", "size").join(first, "digest")
    # splits a hot digest's rows at run time; its other side has one row
    out = keys.join(single, "digest").select(
        F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("row") == F.col("first")).alias("kept"),
        (F.lower(F.hex("digest")) if digest is sha256 else F.col("hex")).alias("text_sha256"))
    shared = groups.where("texts > 1").select("digest")
    if not shared.isEmpty():
        out = out.unionByName(_by_content(rows, shared, salts))
    return out


def _by_content(rows: DataFrame, shared: DataFrame, salts: int) -> DataFrame:
    """Rows whose digest stands for more than one text are matched by their text."""
    rows = stored(rows.join(shared, "digest", "left_semi").withColumn("row", F.monotonically_increasing_id()),
                  "exact-shared")
    by = ["digest", "text"]
    first = rows.groupBy(*by).agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).getField("row").alias("first"))
    return rows.join(combined(rows, salts).join(first, by), by).select(
        F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("row") == F.col("first")).alias("kept"), F.sha2("text", 256).alias("text_sha256"))


SQL = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
