"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import written

MAX_STEPS = 64
#: So many edges are joined on the driver at once, which saves the steps' jobs; results are the same.
DRIVER_EDGES = 100_000


def _joined(u: list[int], v: list[int]) -> dict[int, int]:
    """The least node of the component of each node."""
    above: dict[int, int] = {}

    def root(n: int) -> int:
        path = []
        while (up := above.get(n, n)) != n:
            path.append(n)
            n = up
        above.update(dict.fromkeys(path, n))
        return n

    for a, b in zip(u, v):
        a, b = root(a), root(b)
        above[max(a, b)] = above[min(a, b)] = min(a, b)
    return {n: root(n) for n in list(above)}


def connected_components(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) except the roots, which are the least
    nodes of their components.  Loops and repeated edges don't matter; no edges give no rows.

    Each step is a few shuffles of narrow rows and a written table, so lineage doesn't grow.
    Least neighbours are partial minima that are joined back, so no node's neighbours, however
    many, are ever gathered in one place.  The number of steps grows with the logarithm of the
    longest path; beyond ``MAX_STEPS`` an error is raised and nothing is returned.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    if 0 < now.count() <= driver_edges:
        found = now.toArrow()
        pairs = [(n, r) for n, r in _joined(found["u"].to_pylist(), found["v"].to_pylist()).items() if n != r]
        table = pa.table({"node": pa.array([n for n, _ in pairs], pa.int64()), "root": pa.array([r for _, r in pairs], pa.int64())})
        return written(now.sparkSession.createDataFrame(table), "roots")
    mark = None
    for _ in range(MAX_STEPS):
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = written(small.select(F.col("e.u").alias("u"), F.col("e.v").alias("v")).where("u <> v").distinct(), "edges")
    raise RuntimeError(f"no convergence in {MAX_STEPS} steps")
