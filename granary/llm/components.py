"""Distributed union-find over links: parts contract their own links, then roots that meet at a node are linked anew.

A round: each part of the links, ``CHUNK`` at a time, points its nodes to their smallest node in
the part (``forest``); grouped by node, a node then knows all its roots. It goes to the smallest, and the others
become links of the next, smaller round. A node of very many links is one row a part, so
no task holds its links. From round ``PLAIN`` on, roots are the first in an order by hash, a new one each
round, so that long chains too shrink by a constant factor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Scratch, mix

CHUNK = 1 << 18
PLAIN = 4


def forest(a: np.ndarray, b: np.ndarray, order: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (a, b), and the first node of each one's component: the smallest, or the first by a hash with ``order``."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    if order:
        by_hash = np.argsort(mix(nodes.view(np.uint64) + np.uint64(order)), kind="stable")
        rank = np.empty_like(by_hash)
        rank[by_hash] = np.arange(len(nodes))
        nodes, at = nodes[by_hash], rank[at]
    i, j = at[: len(a)], at[len(a) :]
    p = np.arange(len(nodes))
    while True:
        high, low = np.maximum(p[i], p[j]), np.minimum(p[i], p[j])
        open_ = high != low
        if not open_.any():
            return nodes, nodes[p]
        i, j = i[open_], j[open_]
        np.minimum.at(p, high[open_], low[open_])
        while (p[p] != p).any():
            p = p[p]


def _forests(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        a, b = (np.concatenate([h.column(c).to_numpy(zero_copy_only=False) for h in held]) for c in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(a, b, order)], ["u", "r"])

    for batch in batches:
        held.append(batch)
        if sum(h.num_rows for h in held) >= CHUNK:
            yield out()
            held = []
    if held:
        yield out()


def connected_components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(id, component) for every node of ``links`` (a, b) that isn't its component's smallest; component is the smallest id.

    Links may repeat, go either way and join a node to itself; without links the result is
    empty. Each round is written to the shared folder, so lineage stays short and lost executors
    cost one round.
    """
    tables, edges = [], links.select("a", "b")
    while True:
        k = len(tables)
        order = 0 if k < PLAIN else k
        rows = edges.mapInArrow(lambda batches, order=order: _forests(batches, order), "u bigint, r bigint")
        first = F.min_by("r", F.struct(F.xxhash64("r", F.lit(order)), "r")) if order else F.min("r")
        table = scratch.write(rows.groupBy("u").agg(first.alias("m"), F.collect_set("r").alias("roots")), f"{name}-{k}")
        tables.append(table)
        several = table.filter(F.size("roots") > 1)
        if several.isEmpty():
            break
        edges = several.select(F.explode("roots").alias("a"), F.col("m").alias("b")).filter("a <> b")
    out = tables[0].select("u", "m")
    for t in tables[1:]:
        out = out.join(t.filter("u <> m").select(F.col("u").alias("m"), F.col("m").alias("to")), "m", "left").select("u", F.coalesce("to", "m").alias("m"))
    if len(tables) > PLAIN:
        least = out.groupBy("m").agg(F.min("u").alias("least"))
        out = out.join(least, "m").select("u", F.col("least").alias("m"))
    out = scratch.write(out.filter("u <> m").toDF("id", "component"), f"{name}-all")
    scratch.drop(*(f"{name}-{k}" for k in range(len(tables))))
    return out
