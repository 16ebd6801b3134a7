"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a bounded sample: k-means, then lists far above the mean size are split and the
smallest given up, until lists are balanced. A graph over the centroids, held in memory, finds the
lists near a vector by best-first search. Every vector of the table is posted to its
nearest list and, near a boundary, to the further lists whose distance is within a ratio of
the nearest and that no chosen list already covers. A query takes lists by distance until they
surely hold several times the vectors asked for, and all lists within a ratio of the last one's
distance; posted vectors are scored exactly, in blocks. Queries that still find too few are
compared with every vector.

Largest inner product becomes least distance by one more component, sqrt(M^2 - |v|^2), with M the
largest norm; queries have 0 there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import Scratch


@dataclass(frozen=True)
class Options:
    """sample_bytes: of vectors that centroids are fit on. list_rows: rows a list holds on average, until max_lists is reached.

    replicas, posting_ratio: lists a vector is posted to, at most, and how much farther than the
    nearest they may be. search_ratio: the same for the lists that a query searches, of any
    number, against the list with which they hold more than ``spare`` times the vectors asked for. beam: of the graph search, at least beam_share of all lists for queries: vectors without
    clusters need many lists. block: vectors scored by one matrix product.
    """

    sample_bytes: int = 16 << 20
    list_rows: int = 256
    max_lists: int = 8192
    links: int = 32
    replicas: int = 4
    posting_ratio: float = 1.10
    search_ratio: float = 1.11
    spare: int = 4
    beam: int = 64
    beam_share: float = 0.4
    block: int = 512
    seed: int = 11


def usable(v: Column, size: int | None = None) -> Column:
    """Not null, not zero, all components finite, of ``size`` components."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    return F.coalesce(out if size is None else out & (F.size(v) == size), F.lit(False))


def _nearest(x: np.ndarray, c: np.ndarray, step: int = 4096) -> np.ndarray:
    cc = (c * c).sum(1)
    return np.concatenate([np.argmin(cc - 2 * x[i : i + step] @ c.T, axis=1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, int)


def balanced_centroids(x: np.ndarray, k: int, seed: int, rounds: int = 6) -> np.ndarray:
    """At most ``k`` centroids of ``x``; lists above twice the mean are split and as many of the smallest dropped, a few times."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for r in range(2 * rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        order = np.argsort(own, kind="stable")
        starts = np.concatenate([[0], np.cumsum(n)])[:-1]
        full = np.flatnonzero(n)
        c[full] = np.add.reduceat(x[order], starts[full], axis=0) / n[full, None]
        if r < 2 * rounds - 2:
            over = np.flatnonzero(n > max(2, 2 * len(x) / k))
            under = np.argsort(n, kind="stable")[: len(over)]
            for a, b in zip(over[np.argsort(-n[over])], under, strict=True):
                if n[b] * 4 < n[a]:
                    members = x[order[starts[a] : starts[a] + n[a]]]
                    far = members[np.argmax(((members - c[a]) ** 2).sum(1))]
                    c[b] = (c[a] + far) / 2
    return np.unique(c, axis=0)


@dataclass
class Graph:
    """Centroids (bounded by ``max_lists``), each linked to its nearest and a few random others; searches start at ``entries``.

    held: of each list, the vectors whose nearest list it is; replicas don't count, so sums over lists are of different vectors.
    """

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray
    held: np.ndarray

    @classmethod
    def build(cls, c: np.ndarray, links: int, seed: int) -> Graph:
        rng = np.random.default_rng(seed)
        near = min(links, len(c) - 1)
        cc = (c * c).sum(1)
        rows = []
        for i in range(0, len(c), 1024):
            d = cc - 2 * c[i : i + 1024] @ c.T
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            rows.append(np.argpartition(d, near - 1, axis=1)[:, :near] if near else np.zeros((len(d), 0), int))
        far = rng.integers(0, len(c), (len(c), min(8, len(c))))
        entries = rng.choice(len(c), min(16, len(c)), replace=False)
        return cls(c.astype(np.float32), np.concatenate([np.concatenate(rows), far], axis=1).astype(np.int32), entries, np.zeros(len(c), np.int64))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``q``, the nearest lists found and their distances, nearest first; -1 and inf where there are fewer."""
        c, cc = self.centroids, (self.centroids**2).sum(1)
        rows, qq = np.arange(len(q)), (q * q).sum(1)
        seen = np.zeros((len(q), len(c)), bool)
        ids = np.full((len(q), beam), -1)
        dist = np.full((len(q), beam), np.inf, np.float32)
        todo = np.zeros((len(q), beam), bool)

        def add(r: np.ndarray, new: np.ndarray) -> None:
            ok = ~seen[r[:, None], new]
            first = np.sort(new, axis=1)  # a link may be there twice
            if (first[:, 1:] == first[:, :-1]).any():
                order = np.argsort(new, axis=1, kind="stable")
                twice = np.zeros_like(ok)
                twice[np.arange(len(r))[:, None], order[:, 1:]] = np.take_along_axis(new, order, 1)[:, 1:] == np.take_along_axis(new, order, 1)[:, :-1]
                ok &= ~twice
            seen[r[:, None], new] = True
            d = np.where(ok, cc[new] - 2 * np.einsum("rd,rld->rl", q[r], c[new]) + qq[r, None], np.inf)
            all_d, all_i = np.concatenate([dist[r], d], axis=1), np.concatenate([ids[r], new], axis=1)
            all_t = np.concatenate([todo[r], ok], axis=1)
            best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            dist[r], ids[r], todo[r] = (np.take_along_axis(a, best, 1) for a in (all_d, all_i, all_t))

        add(rows, np.broadcast_to(self.entries, (len(q), len(self.entries))))
        while True:
            at = np.where(todo, dist, np.inf)
            best = np.argmin(at, axis=1)
            live = np.flatnonzero(np.isfinite(at[rows, best]))
            if not len(live):
                break
            todo[live, best[live]] = False
            add(live, self.links[ids[live, best[live]]])
        order = np.argsort(dist, axis=1, kind="stable")
        dist, ids = np.take_along_axis(dist, order, 1), np.take_along_axis(ids, order, 1)
        return np.where(np.isfinite(dist), ids, -1), np.sqrt(np.maximum(dist, 0))

    def posting_lists(self, x: np.ndarray, o: Options) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: the nearest list, and boundary lists not nearer to a chosen list than to the vector."""
        ids, dist = self.search(x, max(16, 4 * o.replicas))
        ids, dist = ids[:, : 3 * o.replicas], dist[:, : 3 * o.replicas]
        chosen = np.zeros(ids.shape, bool)
        chosen[:, 0] = True
        ok = (ids >= 0) & (dist <= o.posting_ratio * dist[:, :1] + 1e-7)
        for j in range(1, ids.shape[1]):
            take = ok[:, j] & (chosen.sum(1) < o.replicas)
            for i in range(j):
                between = np.sqrt(((self.centroids[ids[:, i]] - self.centroids[ids[:, j]]) ** 2).sum(1))
                take &= ~(chosen[:, i] & (between < 0.4 * dist[:, j]))
            chosen[:, j] = take
        row, j = np.nonzero(chosen)
        return row, ids[row, j]

    def search_lists(self, q: np.ndarray, o: Options, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: a query on the centroid of a small group has distance 0 to it, so the ratio alone wouldn't leave the group."""
        ids, dist = self.search(q, max(o.beam, int(len(self.centroids) * o.beam_share)))
        enough = np.where(ids >= 0, self.held[ids], 0).cumsum(1) > o.spare * k
        reach = np.where(enough.any(1), dist[np.arange(len(q)), enough.argmax(1)], np.inf)
        row, j = np.nonzero((ids >= 0) & (dist <= o.search_ratio * reach[:, None] + 1e-7))
        return row, ids[row, j]


@dataclass
class Index:
    """graph: in memory. postings: (list, part, cells, held) with cells an array of (id, vector as float32 bytes), at most about ``block`` each."""

    graph: Graph | None
    postings: DataFrame
    largest: float
    size: int
    options: Options


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float32).reshape(-1, size)


def _cells(rows: DataFrame, o: Options, block: int) -> DataFrame:
    """(list, part, cells) of rows (list, id, vector). Lists of any length: a list has as many parts as it needs."""
    parts = rows.groupBy("list").agg(F.ceil(F.count("*") / block).alias("parts"))
    rows = rows.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("id", "vector"), F.col("parts")))
    return rows.groupBy("list", "part").agg(F.collect_list(F.struct("id", "vector")).alias("cells"), F.count_if("first").alias("held"))


def _listed(rows: DataFrame, graph: Graph, size: int, largest: float, k: int | None, o: Options) -> DataFrame:
    """(list, id, vector, first) of rows (id, v): the lists a vector is posted to, or with ``k`` those that a query for so many searches. first: its nearest."""
    sent = rows.sparkSession.sparkContext.broadcast(graph)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = _matrix(part.column(1), size)
                extra = np.zeros((len(x), 1), np.float32) if k is not None else np.sqrt(np.maximum(0, largest**2 - (x.astype(np.float64) ** 2).sum(1)))[:, None].astype(np.float32)
                x1 = np.concatenate([x, extra], axis=1)
                row, lists = g.posting_lists(x1, o) if k is None else g.search_lists(x1, o, k)
                first = np.diff(row, prepend=-1) > 0
                vectors = pa.array([x[i].tobytes() for i in range(len(x))], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), part.column(0).take(pa.array(row)), vectors.take(pa.array(row)), pa.array(first)], ["list", "id", "vector", "first"])

    return rows.mapInArrow(run, "list int, id bigint, vector binary, first boolean")


def build_index(df: DataFrame, key: str, vector: str, o: Options = Options(), scratch: Scratch | None = None) -> Index:
    """Index every usable vector of ``df``. Others (null, zero, with null or non-finite components, or of another than the commonest size) take no part."""
    spark = df.sparkSession
    scratch = scratch or Scratch(spark, "vectors")
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v")).filter("id IS NOT NULL").filter(usable(F.col("v")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.max(norm).alias("norm")).orderBy(F.desc("n"), "size").first()
    if sizes is None:
        return Index(None, spark.createDataFrame([], "list int, part bigint, cells array<struct<id:bigint,vector:binary>>, held bigint"), 0.0, 0, o)
    size, n, largest = sizes["size"], sizes["n"], float(sizes["norm"])
    rows = rows.filter(F.size("v") == size)
    most = max(1, o.sample_bytes // (4 * size))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(most).toArrow()
    x = _matrix(sample["v"].combine_chunks(), size)
    x = np.concatenate([x, np.sqrt(np.maximum(0, largest**2 - (x.astype(np.float64) ** 2).sum(1)))[:, None].astype(np.float32)], axis=1)
    lists = max(1, min(o.max_lists, -(-n // o.list_rows), len(x) // 4))
    graph = Graph.build(balanced_centroids(x, lists, o.seed), o.links, o.seed)
    postings = scratch.write(_cells(_listed(rows, graph, size, largest, None, o), o, o.block), "postings")
    for r in postings.groupBy("list").agg(F.sum("held").alias("held")).collect():
        graph.held[r["list"]] = r["held"]
    return Index(graph, postings, largest, size, o)


def search(index: Index, queries: DataFrame, key: str, vector: str, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` largest inner products found, its own id left out; ties to the smaller id.

    A query has fewer than ``k`` rows only if the index has fewer other ids. Queries that are not
    usable get no rows. Rows of ``queries`` that share an id are one query.
    """
    o, size, spark = index.options, index.size, queries.sparkSession
    schema = "query_id bigint, vec_id bigint, score double"
    if index.graph is None:
        return _ranked(spark.createDataFrame([], schema), k)
    scratch = Scratch(spark, "nearest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (vi, v), (qi, q) = (_unpacked(batch.column(c)[i].values, size) for c in (0, 1))
                again = len(vi) - len(np.unique(vi))  # rows that share an id don't take another's place
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in top(qi, q, vi, v, k + again)], ["query_id", "vec_id", "score"])

    def scored(pairs: DataFrame) -> DataFrame:
        return _ranked(pairs.select("cells", "asked").mapInArrow(run, schema).dropDuplicates(["query_id", "vec_id"]), k)

    rows = queries.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v")).filter("id IS NOT NULL").filter(usable(F.col("v"), size))
    asked = _cells(_listed(rows, index.graph, size, index.largest, k, o), o, 256).select("list", F.col("cells").alias("asked"))
    found = scratch.write(scored(index.postings.join(asked, "list")), "found")
    full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = scratch.write(rows.join(full, "id", "left_anti"), "short")
    if short.isEmpty():
        return found

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), size)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), np.int32)), batch.column(0), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(np.ones(len(x), bool))], ["list", "id", "vector", "first"])

    asked = _cells(short.mapInArrow(packed, "list int, id bigint, vector binary, first boolean"), o, 256).select(F.col("cells").alias("asked"))
    every = scored(index.postings.crossJoin(asked))
    return found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(every)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _unpacked(cells: pa.StructArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    ids = cells.field("id").to_numpy(zero_copy_only=False)
    return ids, np.frombuffer(b"".join(cells.field("vector").to_pylist()), np.float32).reshape(-1, size).astype(np.float64)


def top(qi: np.ndarray, q: np.ndarray, vi: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's ``k`` best in a block. Scores are summed in one order whatever the block, so that ties are ties."""
    s = q @ v.T
    s[qi[:, None] == vi[None, :]] = -np.inf
    if s.shape[1] > k:
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        near = s >= (least - 1e-12 * np.maximum(1, np.abs(least)))[:, None]
    else:
        near = np.ones(s.shape, bool)
    near &= s > -np.inf
    a, b = np.nonzero(near)
    exact = np.concatenate([(q[a[i : i + 65536]] * v[b[i : i + 65536]]).sum(1) for i in range(0, len(a), 65536)]) if len(a) else np.zeros(0)
    order = np.lexsort((vi[b], -exact, a))
    a, b, exact = a[order], b[order], exact[order]
    nth = np.arange(len(a)) - np.searchsorted(a, a)
    keep = nth < k
    return qi[a[keep]], vi[b[keep]], exact[keep]


def op2_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every 20th vector, among all others."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = build_index(rows, "vec_id", "embedding")
    return search(index, rows.filter(F.col("vec_id") % 20 == 0), "vec_id", "embedding", 20)
