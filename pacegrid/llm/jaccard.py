"""Near duplicates by an n-gram Jaccard join with vertical partitioning.

A document's set holds the 64-bit hashes of its distinct word 5-grams. All sets stand in one
global order of n-grams: rare ones by hash, then frequent ones by falling rarity. The order is
cut into fragments; a set's part in a fragment is a segment. For pairs of candidates the
overlap is counted in each fragment on its own, and the counts are summed per pair.

Candidates share one of the ``n - ceil(0.8 n) + 1`` first n-grams of their orders: any pair of
similarity 0.8 does. Documents of equal sets are one node, and pairs are only needed between
nodes that aren't linked otherwise yet:

1. star rounds compare each node with a few leaders that it shares most first n-grams with, so
   a group of thousands of near copies falls together by a few pairs per node;
2. the last round takes every remaining candidate pair of nodes in different components. First
   n-grams that at most ``RARE`` nodes share give their pairs at once. A pair that only has
   more crowded ones has two crowded ends. For each crowded n-gram such a node takes a few of the
   ``SPARE`` n-grams kept behind its first ones; these are counted as well, and in a second order
   the ones that more than ``RARE`` nodes have come last: a passage of many documents is passed
   over, and documents that share little else don't meet. Short nodes, which run out of rare
   n-grams that way, have their whole sets counted: they meet each other in the exact order of
   rarity, and other crowded nodes at these nodes' rare n-grams.

No pair that could link two components is left out, and no group is expanded into all pairs.
Which n-grams count as frequent or crowded only moves work, never results.

Defined results: words are runs of other than white space with A-Z lower-cased; with fewer
than five words the whole sequence is one n-gram; a null or wordless text has an empty set and
links with nothing; repeated rows link like copies; rows with a null id can't be a component's
name unless it has no other; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pacegrid.llm import common
from pacegrid.llm.components import components
from pacegrid.llm.textkernel import flat_shingles, shingle_sets

#: Similarity in percent, words per n-gram, fragments of the global order.
PERCENT, WORDS, FRAGMENTS = 80, 5, 16

#: Fragments whose differences alone already rule out most pairs.
PRUNING = 3

#: A task reports n-grams that occur FREQUENT_LOCAL times among FREQUENT_WINDOW of its n-grams; the
#: FREQUENT_KEPT most frequent ones that reach FREQUENT_LEAST go to the end of the order.
FREQUENT_LOCAL, FREQUENT_WINDOW, FREQUENT_LEAST, FREQUENT_KEPT = 2, 1 << 22, 16, 1 << 18

#: Rounds of star pairs, and leaders that a node is compared with in each.
STAR_ROUNDS, LEADERS = 2, 2

#: Nodes up to which a shared first n-gram gives pairs without the second order; further n-grams
#: that are kept for it, in parts of the first ones.
RARE, SPARE = 8, 0.5

#: Rows of one leader's fragment that meet in one group of the overlap count.
MEMBERS = 256


def frequent_ngrams(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ranks) in hash order of frequent n-grams, ``FREQUENT_KEPT`` at most; a higher
    rank is more frequent. From (id, text)."""

    def count(batches):
        def report(parts):
            grams = np.concatenate(parts)
            parts.clear()
            grams.sort()
            starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]) & np.concatenate([grams[1:] == grams[:-1], [False]]))
            grams, n = grams[starts], np.searchsorted(grams, grams[starts], side="right") - starts
            return pa.RecordBatch.from_arrays([pa.array(common.as_signed(grams)), pa.array(n)], ["gram", "n"])

        parts, held = [], 0
        for batch in common.text_slices(batches, "text"):
            parts.append(flat_shingles(*common.text_buffer(batch.column(1)), WORDS))
            held += len(parts[-1])
            if held >= FREQUENT_WINDOW:
                yield report(parts)
                held = 0
        if parts:
            yield report(parts)

    counted = docs.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT_LEAST)
    top = counted.orderBy(F.col("n").desc(), "gram").limit(FREQUENT_KEPT).toArrow()
    grams = top["gram"].to_numpy().view(np.uint64)
    order = np.argsort(grams)
    return grams[order], np.arange(len(grams), 0, -1)[order]


def in_order(grams: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rare by hash, frequent by rank) of a set sorted by hash."""
    hashes, ranks = frequent
    if not len(hashes):
        return grams, grams[:0]
    at = np.minimum(np.searchsorted(hashes, grams), len(hashes) - 1)
    often = hashes[at] == grams
    return grams[~often], grams[often][np.argsort(ranks[at[often]], kind="stable")]


def signature_of(grams: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def lists_of(parts: list[np.ndarray]) -> pa.ListArray:
    """One list of signed hashes per part."""
    cut = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cut), pa.array(common.as_signed(np.concatenate(parts)) if parts else np.zeros(0, np.int64)))


def signatures(docs: DataFrame, frequent) -> DataFrame:
    """(doc_id, mark, n_shingles, signature, prefix, spare, rid) of every document, written; empty
    sets have no signature."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in common.text_slices(batches, "text"):
            sizes, names, prefixes, spares = [], [], [], []
            for grams in shingle_sets(*common.text_buffer(batch.column(1)), WORDS):
                n = len(grams)
                sizes.append(n)
                names.append(signature_of(grams) if n else None)
                first = n - -(-PERCENT * n // 100) + 1 if n else 0
                window = first + int(SPARE * first)
                rare, often = in_order(grams, shared.value)
                leading = rare[:window] if len(rare) >= window else np.concatenate([rare, often])[:window]
                prefixes.append(leading[:first]), spares.append(leading[first:])
            columns = [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), lists_of(prefixes), lists_of(spares)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "mark", "n_shingles", "signature", "prefix", "spare"])

    found = docs.mapInArrow(run, f"id {id_type}, mark long, n_shingles long, signature binary, prefix array<long>, spare array<long>")
    return common.written(found.withColumnRenamed("id", "doc_id").withColumn("rid", F.monotonically_increasing_id()), "jaccard-signatures")


def named_sets(signed: DataFrame) -> DataFrame:
    """(signature, node, first, owner, mark) of every distinct set, written: its node is the least
    row number that has it, ``owner`` and ``mark`` that row's id and the hash of its text, and
    ``first`` its smallest id."""
    of_node = lambda c: F.min_by(c, "rid")
    sets = signed.filter("signature is not null").groupBy("signature")
    sets = sets.agg(F.min("rid").alias("node"), F.min("doc_id").alias("first"), of_node("doc_id").alias("owner"), of_node("mark").alias("mark"))
    return common.written(sets, "jaccard-sets")


def shared_postings(signed: DataFrame, sets: DataFrame) -> DataFrame:
    """(gram, place, node, n) of first n-grams that several documents have, written. Only a row
    number goes through the large shuffles with each n-gram."""
    postings = signed.filter("signature is not null").select(F.posexplode("prefix").alias("place", "gram"), "rid")
    again = postings.groupBy("gram").agg(F.count("*").alias("rows")).filter("rows > 1").select("gram")
    owners = signed.select("signature", "rid", F.col("n_shingles").cast("int").alias("n")).join(sets, "signature").select("rid", "node", "n")
    named = postings.join(again, "gram").join(owners, "rid").drop("rid")
    return common.written(named.distinct(), "jaccard-postings")


def segments(docs: DataFrame, sets: DataFrame, nodes: DataFrame, frequent, fragments: range) -> DataFrame:
    """(node, fragment, grams) of the given nodes, written. Fragments are equal ranges of hashes;
    the last one takes the frequent n-grams. Only rows with the id and the text's hash of one of
    these nodes are read again, so that rows without an id, or of one id, don't all meet; of rows
    that repeat both a task takes one."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    wanted = sets.join(nodes, "node", "left_semi").select("owner", F.col("mark").alias("wanted"), "signature", "node")
    wanted = common.checked_broadcast(common.written(wanted, "jaccard-wanted"))
    texts = docs.join(wanted, F.col("id").eqNullSafe(F.col("owner")) & (F.col("mark") == F.col("wanted"))).select("text", "signature", "node")
    width = np.uint64(2**64 // (FRAGMENTS - 1) + 1)

    def run(batches):
        done = set()
        for batch in common.text_slices(batches, "text"):
            nodes, numbers, parts = [], [], []
            named = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            for grams, (signature, node) in zip(shingle_sets(*common.text_buffer(batch.column(0)), WORDS), named, strict=True):
                if node in done or not len(grams) or signature_of(grams) != signature:
                    continue
                done.add(node)
                rare, often = in_order(grams, shared.value)
                cuts = np.searchsorted(rare // width, np.arange(FRAGMENTS, dtype=np.uint64))
                for k in fragments:
                    part = np.sort(often) if k == FRAGMENTS - 1 else rare[cuts[k] : cuts[k + 1]]
                    nodes.append(node), numbers.append(k), parts.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(numbers, pa.int32()), lists_of(parts)], ["node", "fragment", "grams"])

    return common.written(texts.mapInArrow(run, "node long, fragment int, grams array<long>"), "jaccard-segments")


def overlaps(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b, n, m, overlap, apart) of the written pairs: n-grams shared, and n-grams of one set
    alone, each counted by fragment and summed over the fragments of ``parts``. A node b that very
    many a meet is repeated, and its rows dealt over the repeats."""
    ends = pairs.groupBy("b").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("deals"))
    ends = common.checked_broadcast(common.written(ends, "jaccard-ends"))
    mine = pairs.join(ends, "b").withColumn("deal", F.pmod(F.xxhash64("a"), F.col("deals")).cast("int")).drop("deals")
    mine = common.checked_broadcast(common.written(mine, "jaccard-mine"))
    left = parts.join(mine, parts.node == mine.a).select("a", "b", "n", "m", "deal", "fragment", F.col("grams").alias("own"))
    right = parts.join(ends, parts.node == ends.b).select("b", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), "fragment", F.col("grams").alias("other"))
    both = left.join(right, ["b", "deal", "fragment"]).withColumn("overlap", F.size(F.array_intersect("own", "other")))
    # A repeated row repeats its segments: one count per fragment goes into the sum.
    apart = F.size("own") + F.size("other") - 2 * F.col("overlap")
    counted = both.groupBy("a", "b", "n", "m", "fragment").agg(F.max("overlap").alias("overlap"), F.max(apart).alias("apart"))
    return counted.groupBy("a", "b", "n", "m").agg(F.sum("overlap").alias("overlap"), F.sum("apart").alias("apart"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def links(pairs: DataFrame, docs: DataFrame, sets: DataFrame, frequent) -> DataFrame:
    """(a, b) of the written pairs (a, b, n, m) whose overlap is large enough, written. The first
    fragments rule out pairs that differ there more than a link may differ anywhere; only the
    others' further segments are made and moved."""
    parts = segments(docs, sets, _ends(pairs), frequent, range(PRUNING))
    early = overlaps(pairs, parts)
    early = early.filter(f"apart <= n + m - 2 * {OVERLAP}").select("a", "b", "n", "m", F.col("overlap").alias("so_far"))
    early = common.written(early, "jaccard-early")
    common.discard(parts)
    parts = segments(docs, sets, _ends(early), frequent, range(PRUNING, FRAGMENTS))
    rest = overlaps(early.select("a", "b", "n", "m"), parts)
    whole = rest.join(early.select("a", "b", "so_far"), ["a", "b"]).withColumn("overlap", F.col("overlap") + F.col("so_far"))
    close = whole.filter(100 * F.col("overlap") >= PERCENT * (F.col("n") + F.col("m") - F.col("overlap")))
    close = common.written(close.select("a", "b"), "jaccard-links")
    common.discard(parts)
    common.tidy(docs.sparkSession)
    return close


#: What a shared n-gram's places in two sets of sizes n and m must allow: with the overlap
#: that a link needs, one of each set's n-grams up to ``size - overlap`` is shared.
OVERLAP = f"(({PERCENT} * (n + m) + {100 + PERCENT} - 1) div {100 + PERCENT})"
LIKELY = f"100 * least(n, m) >= {PERCENT} * greatest(n, m) and place + {OVERLAP} <= n and there + {OVERLAP} <= m"


def _labelled(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return postings.withColumn("label", F.col("node"))
    named = common.checked_broadcast(labels.select(F.col("vertex").alias("node"), "label"))
    return postings.join(named, "node", "left").withColumn("label", F.coalesce("label", "node"))


def star_pairs(labelled: DataFrame, turn: int) -> DataFrame:
    """At most ``LEADERS`` pairs (a, b, n, m) per node: with the leaders it meets most often.
    Each n-gram has one leader: in even turns one of those with fewest
    rarer n-grams (of copies of one text, the least edited), else any, drawn by a hash of
    n-gram, node and ``turn``. Nodes that are linked with theirs already give no pair. Only
    n-grams early enough for a partner of the same size take part; the rest is left to
    ``open_pairs``."""
    early = labelled.filter(f"place + ((2 * {PERCENT} * n + {100 + PERCENT} - 1) div {100 + PERCENT}) <= n")
    first = F.col("place") if turn % 2 == 0 else F.lit(0)
    drawn = F.struct(first.alias("first"), F.xxhash64("gram", "node", F.lit(turn)).alias("draw"), "node", "n", "label", "place")
    lead = early.groupBy("gram").agg(F.min(drawn).alias("lead"), F.count("*").alias("nodes")).filter("nodes > 1").select("gram", "lead")
    met = early.join(lead, "gram").filter("label <> lead.label")
    met = met.select(F.col("node").alias("a"), F.col("lead.node").alias("b"), "n", F.col("lead.n").alias("m"), "place", F.col("lead.place").alias("there")).filter(LIKELY)
    often = met.groupBy("a", "b", "n", "m").agg(F.count("*").alias("times"))
    best = Window.partitionBy("a").orderBy(F.col("times").desc(), "b")
    return often.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= LEADERS).select("a", "b", "n", "m")


def _split(postings: DataFrame, name: str) -> DataFrame:
    """Postings of n-grams that nodes of different labels share, with their number of nodes and the
    label that most of these have, written."""
    by_label = postings.groupBy("gram", "label").agg(F.count("*").alias("rows"))
    seen = by_label.groupBy("gram").agg(F.sum("rows").alias("nodes"), F.count("*").alias("labels"), F.max(F.struct("rows", "label"))["label"].alias("main"))
    return common.written(postings.join(seen.filter("labels > 1").drop("labels"), "gram"), name)


def _across(split: DataFrame) -> DataFrame:
    """Pairs (a, b, n, m) of different labels that share an n-gram, from ``_split`` with a ``level``
    of the node: 0, 1 for settled crowded nodes, 2 for short ones. Two nodes of one level above 0
    give none. Nodes of an n-gram's main label don't meet each other."""
    left = split.filter("label <> main").select("gram", F.col("node").alias("a"), "n", F.col("label").alias("own"), "place", "level")
    right = split.select("gram", F.col("node").alias("b"), F.col("n").alias("m"), F.col("label").alias("other"), F.col("place").alias("there"), F.col("level").alias("high"))
    met = left.join(right, "gram").filter(f"own <> other and not (level > 0 and level = high) and {LIKELY}")
    return met.select("a", "b", "n", "m")


#: Places that a set's first n-grams take.
FIRST = f"100 * place <= {100 - PERCENT} * n"


def second_order(split: DataFrame, signed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings (gram, node, n, label, place) of the settled crowded nodes in the second order, all
    rare; (node, n, label, taken, level) of all crowded nodes, with the number of kept n-grams that
    each takes; and the n-grams that come last. All written.

    The n-grams that come last are one set for all: those that more than ``RARE`` crowded nodes, not
    all of one label, have among their first and taken ones. Each such node passes over every one of
    the set, also where it is the only one that has it as a first one."""
    crowded = split.groupBy("node", "n", "label").agg(F.count_if(F.col("nodes") > RARE).alias("full")).filter("full > 0")
    crowded = common.written(crowded, "jaccard-crowded")
    taken = F.slice("spare", F.lit(1), F.least(F.size("spare"), (2 * F.col("full") + 4).cast("int")))
    windows = signed.join(common.checked_broadcast(crowded), F.col("rid") == F.col("node"))
    windows = windows.select("node", "n", "label", F.size(taken).alias("taken"), F.concat("prefix", taken).alias("grams"))
    rows = windows.select("node", "label", F.explode("grams").alias("gram"))
    held = rows.groupBy("gram").agg(F.count("*").alias("nodes"), F.min("label").alias("least"), F.max("label").alias("most"))
    full = common.written(held.filter(f"nodes > {RARE} and least < most").select("gram"), "jaccard-full")
    passed = rows.join(common.checked_broadcast(full), "gram").groupBy("node").agg(F.collect_list("gram").alias("passed"))
    passed = common.written(passed, "jaccard-passed")
    none = F.array().cast("array<long>")
    windows = windows.join(common.checked_broadcast(passed), "node", "left").withColumn("passed", F.coalesce("passed", none))
    level = F.when(F.size("passed") > F.col("taken"), 2).otherwise(1)
    levels = common.written(windows.select("node", "n", "label", "taken", level.alias("level")), "jaccard-levels")
    settled = windows.filter(level == 1).select("node", "n", "label", F.posexplode(F.array_except("grams", "passed")).alias("place", "gram"))
    settled = common.written(settled.filter(FIRST).select("gram", "node", "n", "label", "place"), "jaccard-windows")
    return settled, levels, full


def rare_meetings(split: DataFrame, signed: DataFrame, levels: DataFrame, grams: DataFrame, full: DataFrame) -> DataFrame:
    """Pairs (a, b, n, m) of a settled and a short node of different labels that share a crowded
    first n-gram, and a rare one among the former's first ones in the second order."""
    short = levels.filter("level = 2").select("node", F.col("n").alias("m"), F.col("label").alias("other"), F.lit(0).alias("there"))
    crowds = split.filter(F.col("nodes") > RARE).select("gram", "node")
    both = crowds.join(common.checked_broadcast(short.select("node")), "node", "left_semi").select("gram").distinct()
    meeting = crowds.join(both, "gram", "left_semi").select("node").distinct()
    settled = common.written(levels.filter("level = 1").join(meeting, "node", "left_semi"), "jaccard-meeting")
    near = signed.join(common.checked_broadcast(settled), F.col("rid") == F.col("node"))
    near = near.select("node", "n", "label", "taken", F.posexplode(F.concat("prefix", F.slice("spare", F.lit(1), F.col("taken")))).alias("at", "gram"))
    # Some n-grams passed over may stand behind this one.
    near = near.withColumn("place", F.greatest(F.lit(0), F.col("at") - F.col("taken"))).filter(FIRST)
    far = grams.distinct().join(full, "gram", "left_anti").join(short, "node")
    met = near.withColumnRenamed("node", "a").join(far.withColumnRenamed("node", "b"), "gram").filter(f"label <> other and {LIKELY}")
    return met.select("a", "b", "n", "m")


def exact_order(short: DataFrame, grams: DataFrame) -> DataFrame:
    """(gram, node, n, label, place) of the first n-grams of the nodes in the order of how many of
    them have an n-gram; those of one node alone, which come first and meet nothing, only count
    as places. ``grams`` (node, gram) has their whole sets; repeats of rows don't count."""
    shared = grams.groupBy("gram").agg(F.count("*").alias("nodes")).filter("nodes > 1")
    own = Window.partitionBy("node")
    placed = grams.join(shared, "gram").withColumn("rank", F.dense_rank().over(own.orderBy("nodes", "gram")))
    placed = placed.withColumn("shared", F.max("rank").over(own)).join(short, "node").withColumn("place", F.col("n") - F.col("shared") + F.col("rank") - 1)
    return placed.filter(FIRST).select("gram", "node", "n", "label", "place").distinct()


def open_pairs(labelled: DataFrame, docs: DataFrame, signed: DataFrame, sets: DataFrame, frequent) -> DataFrame:
    """All pairs (a, b, n, m) of nodes of different labels that may be linked, written: those that
    share a first n-gram of ``RARE`` nodes at most, and pairs of two crowded nodes by the second
    order. A pair with an end that isn't crowded has a first n-gram of the former kind."""
    split = _split(labelled, "jaccard-open")
    settled, levels, full = second_order(split, signed)
    marks = common.checked_broadcast(levels.select("node", "level"))
    marked = split.filter(F.col("nodes") <= RARE).join(marks, "node", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    alike = lambda rows, name: _across(_split(rows, name).withColumn("level", F.lit(0)))
    pairs = _across(marked).unionByName(alike(settled, "jaccard-second"))
    short = levels.filter("level = 2").select("node", "n", "label")
    parts = None
    if not short.isEmpty():
        parts = segments(docs, sets, short.select("node"), frequent, range(FRAGMENTS))
        grams = parts.select("node", F.explode("grams").alias("gram"))
        pairs = pairs.unionByName(alike(exact_order(short, grams), "jaccard-third"))
        pairs = pairs.unionByName(rare_meetings(split, signed, levels, grams, full))
    sized = lambda yes, no: F.when(F.col("a") < F.col("b"), F.col(yes)).otherwise(F.col(no))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), sized("n", "m").alias("n"), sized("m", "n").alias("m"))
    pairs = common.written(pairs.distinct(), "jaccard-candidates")
    if parts is not None:
        common.discard(parts)
    common.discard(split)
    return pairs


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    frequent = frequent_ngrams(rows)
    signed = signatures(rows, frequent)
    sets = named_sets(signed)
    postings = shared_postings(signed, sets)
    labels = None
    if not postings.isEmpty():
        found, tested = [], []
        for turn in range(STAR_ROUNDS):
            pairs = common.written(star_pairs(_labelled(postings, labels), turn), "jaccard-pairs")
            if pairs.isEmpty():
                break
            new = links(pairs, rows, sets, frequent)
            tested.append(pairs)
            if new.isEmpty():
                break
            found.append(new)
            labels = components(_union(found))
        common.tidy(docs.sparkSession)
        pairs = open_pairs(_labelled(postings, labels), rows, signed, sets, frequent)
        for old in tested:
            known = old.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        pairs = common.written(pairs, "jaccard-pairs")
        common.tidy(docs.sparkSession)
        if not pairs.isEmpty():
            new = links(pairs, rows, sets, frequent)
            if not new.isEmpty():
                labels = components(_union([*found, new]))
    nodes = sets.select("signature", "node", "first")
    if labels is not None:
        named = nodes.join(labels.withColumnRenamed("vertex", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        named = common.written(named, "jaccard-named")
        firsts = named.groupBy("label").agg(F.min("first").alias("component"))
        nodes = named.join(firsts, "label").select("signature", F.col("component").alias("first"))
    joined = signed.select("doc_id", "n_shingles", "signature").join(nodes.select("signature", "first"), "signature", "left")
    component = F.when(F.col("signature").isNull(), F.col("doc_id")).otherwise(F.col("first"))
    return joined.select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the row of the
    smallest id, null ids last, and one row where that id repeats. Rows are told apart by number,
    so rows that only share an id, or have none, don't decide on each other."""
    rows, row = common.numbered(docs, "jaccard-rows")
    found = common.written(near_duplicates(rows, row, text_col), "jaccard-found")
    shared = found.groupBy("component_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("component_id")
    named = found.join(shared, "component_id").join(rows.select(row, F.col(id_col).alias("id")), row).select("component_id", F.col(row).alias("number"), "id")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "number")).alias("first")
    named = common.written(named, "jaccard-members")
    kept = named.groupBy("component_id").agg(first).select(F.col("first.number").alias("number"))
    gone = common.written(named.select("number").join(kept, "number", "left_anti").withColumnRenamed("number", row), "jaccard-gone")
    return rows.join(common.checked_broadcast(gone), row, "left_anti").select(*docs.columns)


def op6_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read_table(spark, sf_dir, "documents"))
