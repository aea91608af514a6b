"""Connected components of an undirected graph, on Spark throughout.

First tasks contract links: each takes at most ``per_task`` of them, joins their nodes by
union-find and passes on one link per node, to the least node it knows. If the links
fit one task of that size, that is all: one task's contraction is the whole result, and a
step over it would change nothing. Else large-star and small-star steps follow:
every node points its larger (smaller) neighbours at the least node it knows, until
nothing changes. A step is one aggregation to the minimum per node and one join with
it, so a node with very many links costs one partially aggregated group and one skewed
join, which AQE splits. Steps are written to the shared folder: no lineage grows and
lost executors cost one step."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

PER_TASK = 500_000


def _contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of one task -> (node, least node of its part)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = root.setdefault(x, x)
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for f in frames:
        for a, b in zip(f["a"].tolist(), f["b"].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = [x for x in root if root[x] != x]
    if nodes:
        yield pd.DataFrame({"a": nodes, "b": [find(x) for x in nodes]})


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("a > b")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b")


def components(edges: DataFrame, name: str = "components", per_task: int = PER_TASK, most: int = 60) -> DataFrame:
    """(a, b) links of long nodes -> (node, root): root is the least node reachable.

    Only nodes with a link to another node are listed. Null ends and self links are ignored."""
    now = materialize(edges.where("a <> b").select("a", "b"), name)
    tasks = max(1, -(-now.count() // per_task))
    dealt = now.repartition(tasks) if tasks > 1 else now.coalesce(1)  # one task of at most per_task links
    raw, now = now, materialize(dealt.mapInPandas(_contract, "a long, b long"), name)
    release(raw)
    before = None
    for _ in range(most if tasks > 1 else 0):
        old, now = now, materialize(_star(_star(now, True).distinct(), False).distinct(), name)
        release(old)
        seen = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first()
        if seen == before:
            break
        before = seen
    else:
        if tasks > 1:
            raise RuntimeError("components did not settle")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
