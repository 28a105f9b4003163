"""Connected components of things that share groups, as tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewright.llm.common import discard, written

#: Labels of groups (two longs each, some 60 MB as a hash table) are broadcast when counted to be so many at most.
BROADCAST_ROWS = 1_000_000


def components(members: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) from rows (node, grp) of two longs: nodes of a group belong together.

    Each round a group takes the smallest label of its nodes and a node the smallest of its groups, then that
    label's own label; labels travel twice as far each time. No links are made: a group of n nodes stays n rows. A
    group's label is one row, pre-aggregated for each task and written: it is broadcast if there are few, else the join
    has a plain exchange on either side, so that Spark splits the members of a hot group. Each round is written, so
    lost executors cost one round; what it replaces is deleted. Without members there are no rows.
    """
    members = written(members.select("node", "grp"), "members")

    def lowest(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
        groups = written(labelled.groupBy("grp").agg(F.min("label").alias("label")), "groups")
        small = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
        return groups, members.join(small, "grp").groupBy("node").agg(F.min("label").alias("label"))

    old, best = lowest(members.select("grp", F.col("node").alias("label")))
    labels = written(best, "labels")
    while True:
        groups, best = lowest(members.join(labels.select("node", "label"), "node"))
        best = written(best.join(labels.select("node", F.col("label").alias("before")), "node"), "labels")
        jumped = best.join(best.select(F.col("node").alias("label"), F.col("label").alias("far")), "label", "left")
        new = written(jumped.select("node", "before", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        changed = new.where("before <> label").limit(1).count()
        for done in (old, labels, best):
            discard(done)
        old, labels = groups, new
        if not changed:
            return labels.select("node", "label")
