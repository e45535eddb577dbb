"""Connected components by contraction, in DataFrame operations alone.

Each round gives every node the smallest id in its closed neighbourhood, carries the edges over to these ids and
drops loops; a component's smallest id always keeps itself, so it is what remains. Rounds grow with the logarithm
of a component's diameter. Sums by node are combined before the shuffle; joins on a hot node are plain equi-joins,
which adaptive execution splits. Each round is kept on the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import keep


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a, b); component is the smallest node reached. Loops are allowed."""
    edges = keep(edges.select(F.col("a").cast("long"), F.col("b").cast("long")), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = keep(both.groupBy(F.col("a").alias("at")).agg(F.least(F.col("at"), F.min("b")).alias("to")), "least")
        if labels is None:
            labels = step.select(F.col("at").alias("node"), F.col("to").alias("component"))
        else:
            labels = keep(labels.join(step, labels["component"] == step["at"], "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        a, b = step.select(F.col("at").alias("a"), F.col("to").alias("low_a")), step.select(F.col("at").alias("b"), F.col("to").alias("low_b"))
        edges = keep(edges.filter("a != b").join(a, "a").join(b, "b").filter("low_a != low_b").select(F.least("low_a", "low_b").alias("a"), F.greatest("low_a", "low_b").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels
