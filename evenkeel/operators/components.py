"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.session import discard, materialize


def components(nodes: DataFrame, edges: DataFrame, node: str = "node", left: str = "left", right: str = "right") -> DataFrame:
    """``(node, component)`` where a component is named by its smallest node.

    Each round every node of the remaining graph hooks onto its smallest neighbour, pointers are doubled, and
    edges are redrawn between the targets; loops and repeats vanish, so settled components cost nothing any more and
    a chain of n nodes needs about log n rounds. Minima are taken map-side and a hub's join rows are split by adaptive
    skew handling. Each round writes its pointers and its edges once to the shared folder (a lost executor then repeats
    one round) and deletes the edges before. Edges with a null end link nothing.
    """
    pair = lambda a, b: [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]
    e = materialize(edges.where(F.col(left) != F.col(right)).select(*pair(left, right)).distinct())
    steps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p"))
        onward = hook.select(F.col("u").alias("p"), F.col("p").alias("q"))
        step = materialize(hook.join(onward, "p").select("u", F.col("q").alias("p")))
        steps.append(step)
        redrawn = (e.join(step.select("u", F.col("p").alias("a")), "u")
                   .join(step.select(F.col("u").alias("v"), F.col("p").alias("b")), "v")
                   .where("a <> b").select(*pair("a", "b")).distinct())
        e, old = materialize(redrawn), e
        discard(old)
    every = nodes.select(F.col(node).alias("u")).distinct()
    if not steps:
        done = materialize(every.select(F.col("u").alias(node), F.col("u").alias("component")))
        discard(e)
        return done
    target = steps[-1]
    for step in reversed(steps[:-1]):
        onward = target.select(F.col("u").alias("p"), F.col("p").alias("q"))
        target = step.join(onward, "p", "left").select("u", F.coalesce("q", "p").alias("p"))
    done = materialize(every.join(target, "u", "left").select(F.col("u").alias(node), F.coalesce("p", "u").alias("component")))
    discard(e, *steps)
    return done
