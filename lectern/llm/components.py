"""Connected components of an undirected graph by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, drop, join_hot


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """edges(u, v) -> (id, label) for every id that has an edge; label is the least id of its component.

    Each round takes the least label among the neighbours and then that label's own
    label, so labels travel further each round. The label of a vertex with very many
    neighbours, or of one that is the label of very many, meets them by broadcast (see
    join_hot); no neighbour list is gathered. Each round's labels are written to the
    shared folder, and those of the round before are deleted. Edges to itself and null
    ends are ignored. Raises if rounds did not suffice.
    """
    kept = edges.select("u", "v").where("u <> v")
    both = cut(kept.union(kept.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    degrees = cut(both.groupBy("v").agg(F.count("*").alias("n"), F.least(F.col("v"), F.min("u")).alias("label")), "degrees")
    labels = degrees.select(F.col("v").alias("id"), "label")
    last = degrees
    for _ in range(rounds):
        near = join_hot(both, labels.select(F.col("id").alias("v"), "label"), ["v"], counts=degrees.select("v", "n")).groupBy(F.col("u").alias("id")).agg(F.min("label").alias("near"))
        found = cut(labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label")), "near")
        jump = found.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = cut(join_hot(found, jump, ["label"]).select("id", "old", F.col("far").alias("label")), "labels")
        drop(found)
        if last is not degrees:
            drop(last)
        last, labels = new, new.select("id", "label")
        if new.where("old <> label").isEmpty():
            drop(both, degrees)
            return labels
    raise RuntimeError(f"labels still changed after {rounds} rounds")
