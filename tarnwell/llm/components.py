"""Connected components of an edge table, by contraction: minimum neighbours, pointer jumping, and fewer edges each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.session import drop_written, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, label) for every endpoint of the edges (a, b); label is the smallest id of the component.

    In each round every node points to the smallest of itself and its neighbours, the pointers are followed to their
    ends, and the edges are drawn between the ends alone; those within one end go. At least half of the nodes that
    still have an edge go with them, so the rounds grow with the logarithm of the nodes and all but the first are
    small. At last the rounds' pointers are put together. Nulls are left out; loops name single nodes.
    """
    e = written(edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    for _ in range(most_rounds):
        both = e.select(F.col("a").alias("id"), F.col("b").alias("o")).unionByName(e.select(F.col("b").alias("id"), F.col("a").alias("o")))
        to = written(both.groupBy("id").agg(F.least(F.col("id"), F.min("o")).alias("label")), "pointers")
        for _ in range(most_rounds):  # a pointer's end is a node that points to itself
            nxt = to.select(F.col("id").alias("label"), F.col("label").alias("further"))
            new = written(to.join(nxt, "label").select("id", F.col("further").alias("label"), (F.col("further") != F.col("label")).alias("moved")), "pointers")
            drop_written(to)
            to = new.select("id", "label")
            if new.where("moved").limit(1).count() == 0:
                break
        steps.append(to)
        ends = e.where("a != b").join(to.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(to.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b").where("la != lb")
        left = written(ends.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
        drop_written(e)
        e = left
        if e.limit(1).count() == 0:
            out = steps[0]
            for s in steps[1:]:
                out = out.join(s.select(F.col("id").alias("label"), F.col("label").alias("further")), "label", "left").select("id", F.coalesce("further", "label").alias("label"))
            out = written(out, "labels")
            for s in (*steps, e):
                drop_written(s)
            return out
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
