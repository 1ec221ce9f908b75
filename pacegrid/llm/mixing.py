"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source is expected ``target / source_size`` times. Within its source the
documents stand in the order (size class, md5 of the id, id); the expected copies are
prefix-summed in that order, one random offset per source is added, and a document is emitted
once per integer boundary that its interval crosses. So a document of a rate up to 2 comes at
most twice, and the words taken follow the target over all sizes.

The prefix sum is taken in two steps, so that a source of any size is spread over many tasks:
ranks within blocks of one source, size class and md5 range (about ``BLOCK_ROWS`` rows), and
offsets from the summed counts of blocks. Rows without an id, which all have one md5, are blocks
of their own by size and row number. Only block counts and source totals meet in windows.

Defined results: a null text has size 0; sources are ordered by code point, null last; a
source of size 0 has target 0 and no copies; rows that are equal in all that the order uses
may swap their copies; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pacegrid.llm import common

#: Weights of sources in order, repeating; share of all sizes; most copies of a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0

#: Rows that one block of a size class aims at.
BLOCK_ROWS = 5_000


def size_of(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, rate, start) from (source, source_size).

    Targets share ``share`` of all sizes by weight, none above ``most`` times its source's size;
    the excess is reshared by weight: sources in the order of size over weight are capped as
    long as the level that is left for the rest is above theirs. One row per source meets in
    one window and task here, which is meant for up to some millions of sources; documents never do.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sources.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    levelled = weighed.withColumn(
        "level",
        (F.sum("source_size").over(Window.partitionBy()) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after),
    )
    first = F.first(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("cap"), F.coalesce(first * F.col("weight"), F.col("cap")))
    start = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce("source", F.lit("")), F.when(F.col("source").isNull(), "?").otherwise("")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return levelled.select(
        "source",
        "source_size",
        F.when(F.col("source_size") > 0, target).otherwise(0.0).alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"),
        start.alias("start"),
    )


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken and the
    ``carried`` columns."""
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), *carried
    )
    bits = F.length(F.bin("size"))
    sized = sized.withColumn("class", (bits * 8 + F.expr("shiftright(size, greatest(length(bin(size)) - 3, 0))")).cast("long"))
    sized = common.written(sized.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).withColumn("tie", F.monotonically_increasing_id()), "mix-sizes")

    classes = sized.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    classes = common.written(classes, "mix-classes")
    sources = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")))
    sources = common.checked_broadcast(common.written(sources, "mix-sources"))
    cut = classes.select(F.col("source").alias("c_source"), F.col("class").alias("c_class"), F.ceil(F.col("n") / BLOCK_ROWS).alias("cuts"))
    cut = common.checked_broadcast(cut)
    placed = sized.join(cut, sized.source.eqNullSafe(cut.c_source) & (sized["class"] == cut.c_class)).drop("c_source", "c_class")
    placed = placed.withColumn("block", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("cuts") / F.lit(1 << 32)))

    # Around the md5 that rows without an id share, a block falls into what stands before it, those
    # rows by size and number, and what stands after it.
    unnamed = F.md5(F.lit("").cast("binary"))
    side = F.when(F.col("key") < unnamed, 0).when((F.col("key") == unnamed) & F.col("doc_id").isNull(), 2).when(F.col("key") == unnamed, 1).otherwise(3)
    placed = placed.withColumns({"side": side, "of_size": F.when(side == 2, F.col("size")).otherwise(0), "deal": F.when(side == 2, F.pmod(F.xxhash64("tie"), F.col("cuts"))).otherwise(0)})
    by = ["source", "class", "block", "side", "of_size", "deal"]
    blocks = placed.groupBy(*by).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source").orderBy(*by[1:]).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*(F.col(c).alias(f"b_{c}") for c in by), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    blocks = common.checked_broadcast(common.written(blocks, "mix-blocks"))
    within = Window.partitionBy(*by).orderBy("key", F.col("doc_id").asc_nulls_last(), "size")
    ranked = placed.withColumn("rank", F.row_number().over(within))
    same = F.col("source").eqNullSafe(F.col("b_source"))
    for c in by[1:]:
        same = same & (F.col(c) == F.col(f"b_{c}"))
    ranked = ranked.join(blocks, same)
    s = sources.withColumnRenamed("source", "s_source")
    full = ranked.join(s, F.col("source").eqNullSafe(F.col("s_source")))
    rank = F.col("ahead") + F.col("rank")
    edge = lambda k: F.floor(F.col("start") + F.col("rate") * k)
    full = full.withColumn("copies", edge(rank) - edge(rank - 1))
    return full.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carried)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its columns.

    Copies are carried by row, so null and repeated ids take no part in it.
    """
    rows, row = common.numbered(docs, "mix-rows")
    times = common.fresh(rows, "__times")
    taken = copies(rows, id_col, text_col, source_col, (row,)).filter("copies > 0").select(row, F.col("copies").alias(times))
    taken = common.checked_broadcast(common.written(taken, "mix-copies"))
    joined = rows.join(taken, row)
    return joined.withColumn(common.fresh(joined, "__copy"), F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)


def op9_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    return copies(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), classed AS (
  SELECT *, length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 3, 0)) AS class, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM sized
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, 2e0 * source_size AS cap,
    [5e0, 2e0, 1e0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM sources
), levelled AS (
  SELECT *, row_number() OVER o AS place,
    (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5e0 - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
), lowest AS (
  SELECT arg_min(level, place) AS level FROM levelled WHERE level * weight <= cap
), targets AS (
  SELECT l.source, l.source_size,
    CASE WHEN l.source_size > 0 THEN least(l.cap, coalesce((SELECT level FROM lowest) * l.weight, l.cap)) ELSE 0e0 END AS target,
    CAST('0x' || substr(md5('mix:' || coalesce(source, '') || CASE WHEN source IS NULL THEN '?' ELSE '' END), 1, 8) AS BIGINT) / 4294967296e0 AS start
  FROM levelled l
), ranked AS (
  SELECT c.*, t.source_size, t.target, t.start, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0e0 END AS rate,
    row_number() OVER (PARTITION BY c.source ORDER BY c.class, c.key, c.doc_id NULLS LAST, c.size) AS rank
  FROM classed c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, CAST(floor(start + rate * rank) - floor(start + rate * (rank - 1)) AS BIGINT) AS copies FROM ranked
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, copies FROM taken
"""
