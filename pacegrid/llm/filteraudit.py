"""How five filters interact: a Walsh-Hadamard audit of all their orders.

Each document has a mask of the filters that it fails. Per part and label the scan's tasks sum 32
signed parities of the masks, one for each set of filters; the inverse transform gives the exact
number of documents of each mask. Every order's steps follow from these 32 cells, and so do
Shapley values: a document that fails k filters is removed by each of them in 120 / k orders.

Whether a text repeats a smaller id's is counted over the whole table: rows of texts that occur once
pass, rows of others are held against the smallest id of their text. Only digests and ids are
shuffled, and rows of very frequent texts stay where they are.

Defined results: a null text counts as empty; a null source is the part '', as an empty one is; a
null id is never smaller than another, and its row never repeats one; rows that repeat the smallest
id pass. A document without labels counts as neither good nor toxic; where an id has several labels,
any 1 counts. An empty table gives no parts. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from pacegrid.llm import common

#: The filters in the order of their bits, and the sets of them.
FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)

#: Least words, percent of distinct words and of capitals, characters of code.
WORDS, DISTINCT, CAPITALS, MARKS = 200, 50, 2, "#$%&*|"

SPACE = r"[\x20\x09-\x0D]+"


def own_failures(text: Column) -> Column:
    """The mask of the filters that a text fails by itself, A to D."""
    # Only the first and the last piece can be empty: one in between has characters.
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    failed = [
        F.size(words) < WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT * F.size(words),
        100 * capitals > CAPITALS * F.length(text),
        F.translate(text, MARKS, "") != text,
    ]
    return sum((F.when(f, 1 << bit).otherwise(0) for bit, f in enumerate(failed)), F.lit(0))


def own_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, part, digest, own) of every document, written: the text's digest, and the mask of what
    it fails by itself."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col), F.lit("")).alias("part"),
        F.sha2(text.cast("binary"), 256).alias("digest"),
        own_failures(text).alias("own"),
    )
    return common.written(own.withColumn("digest", F.unhex("digest")), "audit-own")


def masks(own: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every document."""
    again = own.groupBy("digest").agg(F.count("*").alias("rows"), F.min("doc_id").alias("first")).filter("rows > 1")
    found = common.join_by_weight(own, common.written(again, "audit-again"), ["digest"], "rows", "left")
    repeated = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return found.select("doc_id", "part", (F.col("own") + F.when(repeated, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def labelled(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, label, mask): label 1 for good documents, plus 2 for toxic ones."""
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg((one("quality") + 2 * one("toxic")).alias("label")).filter("label > 0")
    known = common.checked_broadcast(common.written(known, "audit-labels"))
    return masked.join(known, "doc_id", "left").select("part", F.coalesce("label", F.lit(0)).alias("label"), "mask")


def parity(mask: Column, chosen: Column | int) -> Column:
    """1 where an even number of the chosen filters failed, else -1."""
    return 1 - 2 * (F.bit_count(mask.bitwiseAND(chosen)) % 2)


def parity_sums(rows: DataFrame) -> DataFrame:
    """(part, label, sums): for each set of filters, in the order of their bits, the sum of the rows'
    parities."""
    sums = [F.sum(parity(F.col("mask"), chosen).cast("long")).alias(f"s{chosen}") for chosen in range(SETS)]
    return rows.groupBy("part", "label").agg(*sums).select("part", "label", F.array(*(f"s{chosen}" for chosen in range(SETS))).alias("sums"))


def cells(sums: DataFrame) -> DataFrame:
    """(part, docs, good, toxic): the number of documents of each mask, of all and of the labelled
    ones. The transform is its own inverse but for the factor of 32."""
    total = lambda keep: F.array(*(F.sum(F.when(keep, F.element_at("sums", chosen + 1)).otherwise(0)) for chosen in range(SETS)))
    label = F.col("label")
    added = sums.groupBy("part").agg(total(label >= 0).alias("docs"), total(label.bitwiseAND(1) > 0).alias("good"), total(label.bitwiseAND(2) > 0).alias("toxic"))

    def inverse(name: str) -> Column:
        signed = lambda mask: F.aggregate(
            F.transform(name, lambda s, chosen: s * parity(mask, chosen)), F.lit(0).cast("long"), lambda so_far, s: so_far + s
        )
        return F.transform(F.sequence(F.lit(0), F.lit(SETS - 1)), lambda mask: F.shiftright(signed(mask), len(FILTERS))).alias(name)

    return added.select("part", *(inverse(name) for name in ("docs", "good", "toxic")))


def steps(counted: DataFrame) -> DataFrame:
    """One row per part, order and step with the counts of that step."""
    orders = ["".join(order) for order in permutations(FILTERS)]
    each = counted.select("*", F.explode(F.lit(orders)).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = F.lit([1 << bit for bit in range(len(FILTERS))])
    bit = lambda step: F.element_at(bits, F.instr(F.lit(FILTERS), F.substring(F.col("filter_order"), step, F.lit(1))))
    passed = F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), F.lit(0), lambda so_far, k: so_far + F.when(k < F.col("step"), bit(k)).otherwise(0))
    each = each.withColumns({"own": bit(F.col("step")), "before": passed})

    def total(name: str, weight) -> Column:
        """Sum over masks of a cell times its weight."""
        weighted = F.transform(name, lambda docs, mask: docs * weight(mask))
        return F.aggregate(weighted, F.lit(0).cast("long"), lambda so_far, docs: so_far + docs)

    yes = lambda condition: F.when(condition, 1).otherwise(0)
    fails = lambda mask: mask.bitwiseAND(F.col("own")) != 0
    gone = lambda mask: mask.bitwiseAND(F.col("before")) != 0
    removed = lambda mask: yes(fails(mask) & ~gone(mask))
    share = lambda mask: F.when(fails(mask), F.try_divide(F.lit(len(orders)), F.bit_count(mask)).cast("long")).otherwise(0)
    return each.select(
        "part",
        "filter_order",
        "step",
        total("docs", lambda mask: yes(~fails(mask) & ~gone(mask))).alias("kept"),
        total("docs", removed).alias("removed"),
        total("docs", lambda mask: yes(fails(mask) & gone(mask))).alias("redundant"),
        total("docs", lambda mask: yes(mask == F.col("own"))).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        total("docs", share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per part, filter order and step; ``labels`` has doc_id, quality and toxic."""
    own = own_masks(docs, id_col, text_col, source_col)
    counted = common.written(cells(parity_sums(labelled(masks(own), labels))), "audit-cells")
    common.discard(own)
    return steps(counted)


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "labels"))


#: The same by walking each order over the documents' own failures.
ORACLE_SQL = r"""
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts),
firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
failed AS (
  SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > first, false) AS e
  FROM worded JOIN firsts USING (text)
), known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
grouped AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
         || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails,
         count(*) AS docs, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM failed LEFT JOIN known USING (doc_id) GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
orders AS (
  SELECT letter AS filter_order FROM letters
  UNION ALL SELECT filter_order || letter FROM orders JOIN letters ON NOT contains(filter_order, letter)
), stages AS (
  SELECT filter_order, step, substr(filter_order, CAST(step AS INT), 1) AS own, substr(filter_order, 1, CAST(step - 1 AS INT)) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE length(filter_order) = 5
), judged AS (
  SELECT part, filter_order, step, own, docs, good, toxic, fails = own AS only_this, contains(fails, own) AS fail,
         length(translate(fails, before, '')) < length(fails) AS gone
  FROM grouped, stages
), stepped AS (
  SELECT part, filter_order, step, own, sum(docs) FILTER (NOT fail AND NOT gone) AS kept, sum(docs) FILTER (fail AND NOT gone) AS removed,
         sum(docs) FILTER (fail AND gone) AS redundant, sum(docs) FILTER (only_this) AS unique_fails,
         sum(good) FILTER (fail AND NOT gone) AS good_lost, sum(toxic) FILTER (fail AND NOT gone) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley
FROM stepped
"""
