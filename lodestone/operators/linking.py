"""Connected components of links, in a number of rounds logarithmic in their length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.tables import counted, discard, durable, held, looked_up


def components(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """id, component (the smallest id reachable) for every id in edges (x, y).

    In each round every node hooks on to its smallest neighbour, pointer jumping brings each to the root of its tree,
    and the edges are contracted to those left between roots. A root either takes in all its neighbours or meets a
    smaller one, so two rounds at least halve the nodes, and jumps double the height that they climb: the number of
    tables made is logarithmic. A node known to hang from a root takes no part in further jumps. The rounds' maps,
    each smaller than the one before, are put together at the end. `rounds` gets the number of jumps of every round.
    """
    edges, left = counted(edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct())
    maps = []
    while left or not maps:
        both = edges.union(edges.select("y", "x"))
        hooks = both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("up")).select("node", F.least("node", "up").alias("up"))
        hooks, moving = counted(hooks.withColumn("done", F.col("node") == F.col("up")), "not done")
        jumps = 0
        while moving:  # up is an ancestor; done if that is a root
            over = looked_up(hooks.where("not done"), hooks.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", total=moving)
            over = over.select("node", F.col("top").alias("up"), (F.col("up") == F.col("top")).alias("done"))
            old = hooks
            hooks, moving = counted(over.union(hooks.where("done")), "not done")
            discard(old)
            jumps += 1
        maps.append(hooks.drop("done"))
        if rounds is not None:
            rounds.append(jumps)
        up = lambda c, to: hooks.select(F.col("node").alias(c), F.col("up").alias(to))
        over = looked_up(looked_up(edges, up("x", "a"), "x", total=left), up("y", "b"), "y", many=held(edges, "y"), total=left)
        old = edges
        edges, left = counted(over.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct())
        discard(old)
    out = maps.pop()
    for m in reversed(maps):
        out = durable(looked_up(m, out.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left").select("node", F.coalesce("top", "up").alias("up")))
    return out.select(F.col("node").alias("id"), F.col("up").alias("component"))
