"""Connected components of a link table, on the cluster: least-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize


#: Links for which one task writes labels.
ROWS = 100_000


def least_labels(links: DataFrame) -> tuple[DataFrame, str]:
    """(node, label) for the ends of ``links`` (a, b): the least node that each can reach.

    Every round takes the least label among neighbours and then the label of
    that label, so chains shorten by half and stars end in two rounds. Rounds
    are cut by tables in the shared folder, of one file for each ROWS links;
    only counts reach the driver.
    """
    spark = links.sparkSession
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges, edge_path = materialize(both.filter("u != v").distinct(), "edges")
    width = edges.count() // ROWS + 1
    labels, at = materialize(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")).coalesce(width), "labels")
    while True:
        near = edges.join(labels, F.col("v") == F.col("node")).groupBy(F.col("u").alias("n_node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("n_node")).select("node", F.least("label", "near").alias("low"), "label")
        jump = labels.select(F.col("node").alias("j_node"), F.col("label").alias("j_label"))
        new = lower.join(jump, F.col("low") == F.col("j_node"), "left").select("node", F.least("low", "j_label").alias("label"), (F.least("low", "j_label") < F.col("label")).alias("changed"))
        new, new_at = materialize(new.coalesce(width), "labels")
        changed = new.filter("changed").limit(1).count()
        discard(spark, at)
        labels, at = new.select("node", "label"), new_at
        if not changed:
            discard(spark, edge_path)
            return labels, at
