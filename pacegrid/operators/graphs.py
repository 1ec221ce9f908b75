"""Strong components of a street network and what is taken from the largest one.

Streets are mostly walked both ways, and nodes with links both ways are in one strong component.
So such pairs are contracted first, as often as new ones arise, by undirected components; what is
left is small and gets trimmed and coloured. Rounds are checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pacegrid import scratch
from pacegrid.operators import network


def _renamed(links: DataFrame, names: DataFrame) -> DataFrame:
    """Links (u, v) with their ends named anew by (node, label), without loops and repeats."""
    for end in ("u", "v"):
        to = names.select(F.col("node").alias(end), "label")
        links = links.join(to, end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
    return links.select("u", "v").filter("u <> v").distinct().transform(scratch.kept)


def _followed(step: DataFrame) -> DataFrame:
    """(node, label) with labels followed to their ends."""
    while True:
        onward = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        now = step.join(onward, "label").select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")).transform(scratch.kept)
        step = now.select("node", "label")
        if now.filter("moved").isEmpty():
            return step


def _joined(pairs: DataFrame) -> DataFrame:
    """(node, label) of the ends of undirected pairs (u, v): the same label over what hangs together.
    Every end goes to its smallest neighbour, and on to where that one goes, by doubling; pairs are
    renamed and thinned out until none is left. Each round at least halves the nodes."""
    labels = None
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = _followed(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label")).transform(scratch.kept))
        if labels is None:
            labels = step
        else:
            further = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = labels.join(further, "label", "left").select("node", F.coalesce("next", "label").alias("label")).transform(scratch.kept)
        pairs = _renamed(pairs, step)
        pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return labels


def _trimmed(links: DataFrame) -> DataFrame:
    """Links between nodes that have links both in and out."""
    while True:
        out, into = links.select("u").distinct(), links.select(F.col("v").alias("u")).distinct()
        inner = out.join(into, "u").transform(scratch.kept)
        left = links.join(inner, "u", "left_semi").join(inner.withColumnRenamed("u", "v"), "v", "left_semi").select("u", "v").transform(scratch.kept)
        if left.count() == links.count():
            return left
        links = left


def _coloured(links: DataFrame) -> DataFrame:
    """(node, label) of the strong components that hold the largest node of their colour: a node's
    colour is the largest node that leads to it, and of a colour's nodes those that lead to that node
    are in its component."""
    colours = links.select(F.col("u").alias("node")).union(links.select("v")).distinct().withColumn("colour", F.col("node")).transform(scratch.kept)
    while True:
        sent = links.join(colours, links.u == colours.node).groupBy("v").agg(F.max("colour").alias("sent"))
        now = colours.join(sent, colours.node == sent.v, "left").select("node", F.greatest("colour", F.coalesce("sent", "colour")).alias("colour"), (F.coalesce("sent", "colour") > F.col("colour")).alias("moved")).transform(scratch.kept)
        colours = now.select("node", "colour")
        if now.filter("moved").isEmpty():
            break
    colour = lambda end: colours.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour"))
    inside = links.join(colour("u"), "u").join(colour("v"), "v").filter("u_colour = v_colour").select("u", "v").transform(scratch.kept)
    found = colours.filter("node = colour")
    fresh = found
    while not fresh.isEmpty():
        more = inside.join(fresh, inside.v == fresh.node).select(F.col("u").alias("node"), "colour").distinct()
        fresh = more.join(found, "node", "left_anti").transform(scratch.kept)
        found = found.unionByName(fresh).transform(scratch.kept)
    return found.select("node", F.col("colour").alias("label"))


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component) of every node; a component's name is its smallest node."""
    labels = nodes.select("node_id", F.col("node_id").alias("label")).transform(scratch.kept)
    links = edges.select("u", "v").filter("u <> v").distinct().transform(scratch.kept)
    while not links.isEmpty():
        turned = links.select(F.col("v").alias("u"), F.col("u").alias("v"))
        names = _joined(links.join(turned, ["u", "v"], "left_semi").filter("u < v").transform(scratch.kept))
        if names is None:
            links = _trimmed(links)
            if links.isEmpty():
                break
            names = _coloured(links)
        links = _renamed(links, names)
        step = names.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = labels.join(step, "label", "left").select("node_id", F.coalesce("next", "label").alias("label")).transform(scratch.kept)
    least = labels.groupBy("label").agg(F.min("node_id").alias("component"))
    return labels.join(least, "label").select("node_id", "component")


def core(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id) of the largest strong component, the one of the smallest node on ties."""
    found = strong_components(nodes, edges).transform(scratch.kept)
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    largest = sizes.agg(F.max(F.struct("size", (-F.col("component")).alias("least"))).alias("best")).select((-F.col("best.least")).alias("component"))
    return found.join(F.broadcast(largest), "component", "left_semi").select("node_id")


def core_nodes(starts: DataFrame, nodes: DataFrame, core_ids: DataFrame, key: str) -> DataFrame:
    """(key, core_node, metres) of starts (key, node_id) whose node isn't in the core: the nearest
    node that is."""
    outside = starts.join(core_ids, "node_id", "left_anti")
    places = outside.join(nodes.select("node_id", F.col("y").alias("lat"), F.col("x").alias("lon")), "node_id").select(key, "lat", "lon")
    found = network.nearest_nodes(places, nodes.join(core_ids, "node_id", "left_semi"), key)
    return found.select(key, F.col("node_id").alias("core_node"), "metres")


def shortest_collapse(edges: DataFrame) -> DataFrame:
    """One edge (u, v, key, length) per pair of ends, the shortest; a missing length counts as 1."""
    length = F.coalesce("length", F.lit(1.0))
    best = edges.groupBy("u", "v").agg(F.min(F.struct(length.alias("length"), "key")).alias("best"))
    return best.select("u", "v", "best.key", "best.length")
