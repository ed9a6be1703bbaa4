"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import forget, written


def _forest(batches):
    """Replace a partition's edges by a star to each local root; keeps connectivity, at most one edge a node."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    u = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in tables])
    v = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in tables])
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    far = np.flatnonzero(root != np.arange(len(nodes)))
    for i in range(0, len(far), 1 << 16):
        part = far[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[root[part]])], names=["u", "v"])


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Smallest reachable node for every node that has an edge.

    edges: columns u and v, both long; self loops, repeats and nulls are ignored.
    Returns node, root; an empty table gives an empty result.  Each round is
    written to the shared folder; only one number a round comes to the driver.
    A hub's edges are first thinned inside each partition.  Minima are
    pre-aggregated and written, so the joins with them have plain tables on both
    sides, which Spark broadcasts when small and otherwise splits at skewed keys.
    Adding edges to a result is cheap: a result's rows are edges themselves.
    """
    e = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    e = written(e.mapInArrow(_forest, "u long, v long").distinct(), "edges")
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_in = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        low = small_in.groupBy("u").agg(F.min("v").alias("m"))
        # one pass: every neighbour and the node itself point to the node's least neighbour
        small = small_in.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")
        new = written(small.distinct(), "edges")
        # finished when every node has one edge and no root has one
        ends = new.select("u", F.lit(1).alias("out"), F.lit(0).alias("root")).unionByName(new.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("root")))
        done = ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("root").alias("root")).where("out > 1 or out + root > 1").isEmpty()
        forget(e, least)
        e = new
        if done:
            break
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
