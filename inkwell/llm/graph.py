"""Connected components of large graphs by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.scratch import Scratch


def contracted(groups: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, near, root) of every node in ``groups`` (node, hub): what hangs together by shared hubs.

    A hub is the least node of a group and a node may be in many. Each node keeps one row with
    its least hub, ``near``; its other hubs are tied to that one, which many nodes say alike,
    so that the distinct ties are few and reduced on the map side. Only hubs then take part in
    the rounds, and a group of near copies costs one row a node whatever its number of hubs.
    """
    rows = scratch.table(groups.groupBy("node").agg(F.min("hub").alias("near"), F.collect_set("hub").alias("hubs")), f"{label}_hubs")
    ties = rows.where(F.size("hubs") > 1).select(F.explode("hubs").alias("a"), F.col("near").alias("b")).where("a != b").distinct()
    # A hub is a node as well, and its own near hub may be a lesser one.
    own = rows.where("node != near").select(F.col("node").alias("a"), F.col("near").alias("b"))
    led = rows.select(F.col("near").alias("a")).union(ties.select("a")).distinct()
    ties = ties.union(own.join(led.hint("merge"), "a", "left_semi"))
    roots = components(ties, scratch, label).withColumnRenamed("node", "near")
    return rows.select("node", "near").join(roots.hint("merge"), "near", "left").select("node", "near", F.coalesce("root", "near").alias("root"))


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b); the root is the component's least node.

    Each round takes the least label among a node's neighbours, moves every edge to the labels
    of its ends and drops the loops, so that chains shrink by half and stars vanish in a round;
    the labels then follow each other. Rounds are written tables; degrees don't matter, for
    neighbours are reduced on the map side. Empty in, empty out.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = scratch.table(edges, f"{label}_edges_0")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root"))
    turn = 0
    while not edges.isEmpty():
        turn += 1
        # The least neighbour of each end, where it is less than the end itself, or that one's own.
        step = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        beyond = step.select(F.col("node").alias("to"), F.col("to").alias("then"))
        step = scratch.table(step.join(beyond, "to", "left").select("node", F.coalesce("then", "to").alias("to")), f"{label}_step_{turn}")
        moved = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a", "left").select(F.coalesce("a2", "a").alias("a"), "b")
        moved = moved.join(step.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b", "left").select("a", F.coalesce("b2", "b").alias("b"))
        moved = moved.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        after = scratch.table(moved, f"{label}_edges_{turn}")
        labels = scratch.table(labels.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), f"{label}_labels_{turn}")
        scratch.drop(f"{label}_edges_{turn - 1}", f"{label}_labels_{turn - 1}", f"{label}_step_{turn}")
        edges = after
    return labels
