"""Exact de-duplication by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after each run of white space became one space. Per row the
scan keeps a key of about a hundred bytes; texts are never shuffled. Lengths and prefix hashes
are counted together, combined in the scan's tasks; only rows whose pair occurs again go on to
the grouping by full hash. That hash is taken in the same scan, since a second one would read
the texts again or shuffle them.

Defined results: a null text counts as empty; of equal texts the row with the smallest id
stays, null ids last; of rows that repeat id and text exactly one stays; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pacegrid.llm import common

#: Characters of the normalised text that the prefix hash covers.
PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One written row per document: rid (row number, unique; that of ``row_col`` if given), doc_id,
    size, prefix, text_sha256."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    norm = docs.select(row.alias("rid"), F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    keyed = norm.select(
        "rid",
        "doc_id",
        F.length("norm").alias("size"),
        F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix"),
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
    )
    return common.written(keyed, "dedup-keys")


def groups(keyed: DataFrame) -> DataFrame:
    """(text_sha256, group_size, keep_rid, keep_id) of every text that occurs more than once,
    written."""
    again = keyed.groupBy("size", "prefix").agg(F.count("*").alias("__rows")).filter(F.col("__rows") > 1)
    rows = common.join_by_weight(keyed, common.written(again, "dedup-again"), ["size", "prefix"], "__rows", "inner")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid"))
    found = rows.groupBy("text_sha256").agg(F.count("*").alias("group_size"), first.alias("first")).filter("group_size > 1")
    return common.written(found.select("text_sha256", "group_size", F.col("first.rid").alias("keep_rid"), F.col("first.doc_id").alias("keep_id")), "dedup-groups")


def exact_groups(keyed: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, rid. Rows of large
    groups aren't brought together."""
    joined = common.join_by_weight(keyed, groups(keyed), ["text_sha256"], "group_size", "left")
    alone = F.col("keep_rid").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        "text_sha256",
        "rid",
    )


def survivors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """(rid, doc_id, size, prefix, text_sha256) of the rows whose length and prefix hash occur again, and
    of no others: only their texts are hashed in full. None where these pairs are too many to be
    broadcast, for then the texts themselves would have to be shuffled."""
    norm = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    sized = norm.withColumns({"size": F.length("norm"), "prefix": F.xxhash64(F.substring("norm", 1, PREFIX_CHARS))})
    again = sized.groupBy("size", "prefix").agg(F.count("*").alias("__rows")).filter(F.col("__rows") > 1)
    again = common.written(again.select("size", "prefix"), "dedup-again")
    # A row of two numbers takes 32 bytes there.
    if again.count() * 32 > common.BROADCAST_BYTES:
        common.discard(again)
        return None
    rows = sized.join(F.broadcast(again), ["size", "prefix"], "left_semi")
    keyed = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "size", "prefix", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    return common.written(keyed, "dedup-survivors")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are told apart by id and full hash, and a full hash is only taken where length and prefix
    hash occur again. Only where a row that stays repeats in both are the rows written once more with
    numbers, and told apart by these. What is known of dropped rows is broadcast where its bytes
    allow; beyond, that join shuffles the rows once.
    """
    keyed = survivors(docs, id_col, text_col)
    keyed = keys(docs, id_col, text_col) if keyed is None else keyed
    result = common.written(exact_groups(keyed), "dedup-result")
    kept = result.filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_sha256") == F.col("kept_sha"))
    dropped = result.filter("not kept")
    if not dropped.join(kept, same, "left_semi").isEmpty():
        rows, row = common.numbered(docs, "dedup-rows")
        gone = exact_groups(keys(rows, id_col, text_col, row)).filter("not kept").select(F.col("rid").alias(row))
        gone = common.checked_broadcast(common.written(gone, "dedup-gone"))
        return rows.join(gone, row, "left_anti").select(*docs.columns)
    # Names as of no column of docs; lengths and prefix hashes keep rows without an id apart.
    named = [common.fresh(docs, f"__{c}") for c in ("id", "size", "prefix", "sha")]
    gone = dropped.select("rid", "doc_id", "text_sha256").join(keyed.select("rid", "size", "prefix"), "rid")
    gone = gone.select(*(F.col(c).alias(n) for c, n in zip(("doc_id", "size", "prefix", "text_sha256"), named, strict=True))).distinct()
    gone = common.checked_broadcast(common.written(gone, "dedup-gone"))
    common.discard(keyed), common.discard(result)
    own = normalised(F.col(text_col))
    length, prefix = common.fresh(docs, "__length"), common.fresh(docs, "__start")
    sized = docs.withColumns({length: F.length(own), prefix: F.xxhash64(F.substring(own, 1, PREFIX_CHARS))})
    met = sized[id_col].eqNullSafe(gone[named[0]]) & (sized[length] == gone[named[1]]) & (sized[prefix] == gone[named[2]])
    # Not an equality that the join could take as a key: only rows that meet by the others are hashed.
    met = met & F.array_contains(F.array(gone[named[3]]), F.sha2(own.cast("binary"), 256))
    return sized.join(gone, met, "left_anti").select(*docs.columns)


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    return exact_groups(keys(docs)).drop("rid")


ORACLE_SQL = r"""
WITH norm AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) AS rn FROM norm
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY rn) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       rn = 1 AS kept,
       text_sha256
FROM numbered
"""
