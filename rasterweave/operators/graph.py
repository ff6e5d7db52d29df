"""Connected components of a graph as a table, by contraction.

Every node hooks to its least neighbour if that is smaller, chains of hooks are shortened by doubling, and edges
are drawn between what is left: of neighbours at most every second one stays, so rounds grow with the logarithm of
the nodes and tables shrink from round to round. Rounds are written to the shared folder, nothing is held in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.sources.session import written


def contract(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, root) of every node that reaches a smaller one, root the smallest; ``edges`` are
    (keys, u, v) and join nodes of the same keys."""
    ordered = edges.where("u <> v").select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = written(ordered.distinct(), "edges")
    found = None
    while not e.isEmpty():
        hooks = shortened(written(e.groupBy(*keys, "u").agg(F.min("v").alias("v")), "hooks"), keys)
        for end in ("u", "v"):
            to = hooks.select(*keys, F.col("u").alias(end), F.col("v").alias("to"))
            e = e.join(to, [*keys, end], "left").withColumn(end, F.coalesce("to", end)).drop("to")
        e = written(e.where("u <> v").select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        new = hooks.select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))
        if found is not None:
            on = hooks.select(*keys, F.col("u").alias("root"), F.col("v").alias("to"))
            new = found.join(on, [*keys, "root"], "left").select(*keys, "node", F.coalesce("to", "root").alias("root")).unionByName(new)
        found = written(new, "roots")
    return found if found is not None else e.select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))


def shortened(hooks: DataFrame, keys: list[str]) -> DataFrame:
    """Each u with the end of its chain of hooks."""
    while True:
        up = hooks.select(*keys, F.col("u").alias("v"), F.col("v").alias("to"))
        longer = hooks.select(*keys, "u", "v").join(up, [*keys, "v"], "left")
        hooks = written(longer.select(*keys, "u", F.coalesce("to", "v").alias("v"), F.col("to").isNotNull().alias("moved")), "hooks")
        if hooks.where("moved").isEmpty():
            return hooks.drop("moved")
