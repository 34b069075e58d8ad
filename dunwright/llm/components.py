"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, label): the smallest node that links reach.  Nodes without links are absent.

    Every round takes the smallest label among neighbours and then the label of that label; rounds are
    written to the shared folder, and the loop ends when nothing changes.  Hubs are folded by combining
    aggregates, so a node with very many links is no hot task.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
                   .filter("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.expr("least(min(b), a) label")), "labels")
    while True:
        offered = both.join(labels, F.expr("a = node")).groupBy("b").agg(F.expr("min(label) offer"))
        hooked = labels.join(offered, F.expr("node = b"), "left") \
            .selectExpr("node", "least(label, coalesce(offer, label)) label", "label old")
        jump = hooked.selectExpr("node root", "label root_label")
        jumped = written(hooked.join(jump, F.expr("label = root"), "left").selectExpr(
            "node", "least(label, coalesce(root_label, label)) label", "old"), "labels")
        labels = jumped.select("node", "label")
        if jumped.filter("label <> old").isEmpty():
            return labels
