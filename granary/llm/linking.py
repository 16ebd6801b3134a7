"""From shared buckets to components of exactly verified links, without all pairs of a bucket.

Items that share a bucket are candidates; each has a sketch of its minwise hashes, and pairs whose
sketches can hardly be those of a link are never made. Linear work comes first: every item is compared with two
pivots of its bucket, its smallest and its largest item (in large buckets also with the first by one of a few
hashes), and verified links are joined to components. Buckets above ``small`` are branched by the caller, as deep as
it says, but for those whose items are much alike on average: branching would multiply their rows without parting them.
Of buckets that then still hold several components, small ones compare all pairs across
components. Large ones come together by their main component: items outside it, each once however many buckets it
shares with it, are compared with all of it in blocks, first by their sketches; only items that are alike to one of another
component go on with their payloads, in blocks of bounded bytes that only links leave. Pairs
inside one component can't change the result and are never compared. Tables go as soon as no later step reads them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from granary.llm.common import Scratch, released, spread_join
from granary.llm.components import connected_components

#: Ids up to so many (8 bytes each) are broadcast to pick rows; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of payloads of a block, and of the outsiders that it is compared with at a time.
BLOCK, PROBES = 1 << 20, 1 << 18
#: Rows of a block, and outsiders at a time, where only sketches are compared; pairs of sketches at a time, which stay in a core's cache.
SKETCHES, SEEN = 1 << 14, 1 << 16
#: Cells of a matrix at a time, or pairs that share an element.
CELLS = 1 << 22
#: Elements that fewer than one in so many pairs of sets share are counted pair by pair, others by a product of matrices.
RARE = 256
#: One in so many items is looked at for buckets of very many rows; so many such buckets are broadcast, at the most.
SAMPLED, HOT = 16, 10_000
#: A large bucket of this average similarity to one of its pivots isn't branched, but compared whole.
DENSE = 0.5
#: Orders of the third pivot of large buckets; buckets that hold much the same items share orders, and so pairs.
ORDERS = 8


def pick(rows: DataFrame, key: str, ids: DataFrame, n: int | None = None) -> DataFrame:
    """Rows whose ``key`` is in ``ids`` (item), a written table of ``n`` rows, which may repeat."""
    n = ids.count() if n is None else n
    ids = F.broadcast(ids) if n <= BROADCAST_IDS else ids.distinct()
    return rows.join(ids.withColumnRenamed("item", key), key, "left_semi")


def alike(x: list[str], y: list[str], planes: int = 0) -> str:
    """SQL for how far two sketches, given by their words' names, agree: in how many bits, or in how many of ``planes`` hashes if each word holds one bit of each."""
    pairs = [f"({a} ^ {b})" for a, b in zip(x, y, strict=True)]
    return f"({planes} - bit_count({' | '.join(pairs)}))" if planes else f"({64 * len(x)} - {' - '.join(f'bit_count{p}' for p in pairs)})"


def alike_rows(x: pa.Table, y: pa.Table, words: list[str], agree: int, planes: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two tables (comp, words of a sketch) have one in the other of another component, with sketches that agree in ``agree`` (``alike``) at least."""
    seen, other = np.zeros(x.num_rows, bool), np.zeros(y.num_rows, bool)
    (xw, xc), (yw, yc) = (([t.column(w).to_numpy().view(np.uint64) for w in words], t.column("comp").to_numpy()) for t in (x, y))
    step = max(1, SEEN // max(1, y.num_rows))
    for at in range(0, x.num_rows, step):
        part = slice(at, at + step)
        differ = [a[part, None] ^ b[None, :] for a, b in zip(xw, yw, strict=True)]
        if planes:
            n = planes - np.bitwise_count(np.bitwise_or.reduce(differ)).astype(np.int16)
        else:
            n = 64 * len(words) - sum(np.bitwise_count(d).astype(np.int16) for d in differ)
        ok = (n >= agree) & (xc[part, None] != yc[None, :])
        seen[part] = ok.any(axis=1)
        other |= ok.any(axis=0)
    return seen, other


class Linker:
    """``fetch``: of a table of ids (item), which may repeat, and its number of rows, a table (item, payload). ``to_set``: of a payload, its sorted
    distinct uint64 elements. ``links_of``: of two arrays of payloads, which pairs are links: 100 * intersection >= ``percent`` * union.

    An item may have several payloads and sketches; a pair is a link if any of its payloads' pairs is.
    ``sketch``: a written table (item, x1, x2, ...) of 64-bit words; pairs whose sketches have fewer than ``agree`` equal bits,
    or hashes if each word holds a bit of each of ``planes`` hashes, can hardly be links. ``small``: the largest bucket compared exhaustively.
    """

    def __init__(self, scratch: Scratch, fetch: Callable, to_set: Callable, links_of: Callable, percent: int, sketch: DataFrame, agree: int, small: int = 32, planes: int = 0):
        self.scratch, self.fetch, self.to_set, self.links_of, self.percent = scratch, fetch, to_set, links_of, percent
        self.sketch, self.agree, self.small, self.planes = sketch, agree, small, planes
        self.words = [c for c in sketch.columns if c != "item"] if sketch is not None else []
        self.made, self.names = 0, []

    def _write(self, df: DataFrame, what: str) -> tuple[DataFrame, str]:
        self.made += 1
        self.names.append(f"{what}{self.made}")
        return self.scratch.write(df, self.names[-1]), self.names[-1]

    def verified(self, pairs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Distinct ``pairs`` (a, b), written, and the links among them by their whole payloads; None if there are no pairs."""
        pairs, _ = self._write(pairs.distinct(), "pairs")
        n = pairs.count()
        if not n:
            return pairs, None
        sets, c = self._write(self.fetch(pairs.select(F.explode(F.array("a", "b")).alias("item")), 2 * n), "sets")
        links_of = self.links_of

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(links_of(part.column(2), part.column(3)), pa.bool_()))

        both = pairs.join(sets.toDF("a", "p"), "a").join(sets.toDF("b", "q"), "b").select("a", "b", "p", "q")
        links, _ = self._write(both.mapInArrow(released(compare), "a bigint, b bigint"), "links")
        self.scratch.drop(c)
        return pairs, links

    def _shared(self, members: DataFrame) -> DataFrame:
        """(bucket, item, n, lo, hi, mid) of buckets of several rows, with their pivots; mid is null in small ones.

        Most buckets hold one row, so members are shuffled once and counted where they arrive. Buckets of very many rows show in
        a sample of the items; those, ``HOT`` at the most, are counted before any shuffle and their rows dealt by item.
        """
        some = members.filter(F.pmod(F.xxhash64("item"), F.lit(SAMPLED)) == 0).groupBy("bucket").agg(F.count("*").alias("k"))
        hot, a = self._write(some.filter(f"k > {1000 // SAMPLED}").orderBy(F.desc("k"), "bucket").limit(HOT).select("bucket"), "hot")

        def pivots(item: Column, bucket: str) -> dict[str, Column]:
            mid = F.min_by(item, F.when(item.isNotNull(), F.xxhash64(item, F.pmod(bucket, F.lit(ORDERS)))))
            return {"n": F.count(item), "lo": F.min(item), "hi": F.max(item), "mid": mid}

        counted = members.join(F.broadcast(hot), "bucket", "left_semi").groupBy("bucket").agg(*(c.alias(k) for k, c in pivots(F.col("item"), "bucket").items()))
        counted, b = self._write(counted.select("bucket", F.struct("bucket", "n", "lo", "hi", "mid").alias("known")), "counted")
        known = F.col("known").isNotNull()
        # A column, not an expression: windows of one partitioning share a shuffle only if its keys are columns. And one column: rows are
        # sorted by radix then. A counted bucket's row may meet another bucket's by its hash, so windows look at rows of the others only.
        rows = members.join(F.broadcast(counted), "bucket", "left").select("item", "known", F.when(known, F.xxhash64("item", "bucket")).otherwise(F.col("bucket")).alias("deal"))
        own = Window.partitionBy("deal")
        for k, c in pivots(F.when(~known, F.col("item")), "deal").items():
            rows = rows.withColumn(k, F.when(known, F.col("known")[k]).otherwise(c.over(own)))
            rows = rows.filter("n > 1") if k == "n" else rows
        rows = rows.select(F.when(known, F.col("known")["bucket"]).otherwise(F.col("deal")).alias("bucket"), "item", "n", "lo", "hi", "mid")
        out, _ = self._write(rows.withColumn("mid", F.when(F.col("n") > self.small, F.col("mid"))), "shared")
        self.scratch.drop(a, b)
        return out

    def _star_pairs(self, shared: DataFrame) -> DataFrame:
        """Distinct alike pairs (a, b) of every member and the pivots of its bucket."""
        rows = shared.select("item", F.explode(F.array("lo", "hi", "mid")).alias("pivot")).filter("item <> pivot")
        pairs = rows.select(F.greatest("item", "pivot").alias("a"), F.least("item", "pivot").alias("b")).distinct()
        p, q = ([f"{side}_{w}" for w in self.words] for side in ("p", "q"))
        sketch = self.sketch.select("item", *self.words)
        both = pairs.join(sketch.toDF("a", *p), "a").join(sketch.toDF("b", *q), "b")
        return both.filter(f"{alike(p, q, self.planes)} >= {self.agree}").select("a", "b")

    def components(self, members: DataFrame, branch: Callable | None = None, depth: int = 1) -> DataFrame:
        """(id, component), for items that aren't their component's smallest, of ``members`` (bucket, item), a cheap plan over a written table.

        ``branch``: of large buckets' (bucket, item), members of smaller ones; used ``depth`` - 1 times.
        """
        levels, dense = [self._shared(members)], []
        while branch and len(levels) < depth:
            large = self._by_density(levels[-1].filter(F.col("n") > self.small))
            open_ = large.filter("NOT dense")
            if open_.isEmpty():  # what is large here is compared whole, with the last level
                break
            members, a = self._write(branch(open_.select("bucket", "item")), "members")
            dense.append(large.filter("dense").select(*levels[0].columns))
            levels.append(self._shared(members))
            self.scratch.drop(a)
        tried, links = self.verified(self._star_pairs(union(levels)))
        if links is None:
            return self._components(tried)
        found = self._components(links)
        # Buckets of up to three rows have been compared whole.
        # Large ones above the last level are compared in their children, if they aren't dense.
        leaves = union([s.filter(f"n > 3 AND n <= {self.small}") for s in levels[:-1]] + dense + [levels[-1].filter("n > 3")])
        rows, _ = self._write(self._named(leaves, found), "rows")
        self._forget("shared", "large", "links")
        pairs = self._small_pairs(rows.filter(F.col("n") <= self.small))
        links = [self.verified(pairs.join(tried, ["a", "b"], "left_anti"))[1], self._crowd_links(rows.filter(F.col("n") > self.small))]
        links = [x for x in links if x is not None]
        found = self._components(union([found.toDF("a", "b"), *links])) if links else found
        self._forget("")
        return found

    def _forget(self, *whats: str) -> None:
        """Drop the tables written so far whose names begin so; components are not among them."""
        self.scratch.drop(*(n for n in self.names if n.startswith(whats)))

    def _by_density(self, large: DataFrame) -> DataFrame:
        """``large`` (bucket, item, n and pivots), written, with a column dense: whether the bucket's items are, on average, alike to one of its pivots.

        Similarity is read off the sketches, where unrelated items agree in half of the bits. How many items of a bucket have
        each bit tells in how many bits a pivot agrees with all of them, so that no item meets its pivots.
        """
        names, halves = ["lo", "hi", "mid"], ["x1", "x2"]
        rows = large.join(self.sketch, "item")
        marks = [F.max(F.when(F.col("item") == F.col(p), F.col(x))).alias(f"{p}_{x}") for p in names for x in halves]
        ones = [F.sum(F.getbit(x, F.lit(j)).cast("bigint")).alias(f"{x}_{j}") for x in halves for j in range(64)]
        sums = rows.groupBy("bucket").agg(F.first("n").alias("n"), F.count("*").alias("held"), *marks, *ones)
        held = F.array(*(F.array(*(F.col(f"{x}_{j}") for j in range(64))) for x in halves))

        def agreed(counts: Column, pivot: Column) -> Column:
            def step(a: Column, k: Column) -> Column:
                same = F.when(F.getbit(pivot, a["j"]) == 1, k).otherwise(F.col("held") - k)
                return F.struct((a["sum"] + same).alias("sum"), (a["j"] + 1).alias("j"))

            return F.aggregate(counts, F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("j")), step)["sum"]

        to_pivots = [agreed(held[0], F.col(f"{p}_x1")) + agreed(held[1], F.col(f"{p}_x2")) for p in names]
        per = sums.select("bucket", "n", (F.greatest(*to_pivots) >= 64 * (1 + DENSE) * F.col("held")).alias("dense"))
        per, a = self._write(per, "density")
        out, _ = self._write(spread_join(large.drop("n"), per, ["bucket"], "n", ["item"]), "large")
        self.scratch.drop(a)
        return out

    def _components(self, links: DataFrame) -> DataFrame:
        self.made += 1
        return connected_components(links, self.scratch, f"cc{self.made}")

    def _named(self, rows: DataFrame, found: DataFrame) -> DataFrame:
        """(bucket, n, m) of ``rows`` (bucket, item, n): m has item, its sketch and comp, its component."""
        named = rows.join(self.sketch.join(found.withColumnRenamed("id", "item"), "item", "left"), "item")
        return named.select("bucket", "n", F.struct("item", F.coalesce("component", "item").alias("comp"), *self.words).alias("m"))

    def _small_pairs(self, rows: DataFrame) -> DataFrame:
        """Pairs across components in buckets of bounded size."""
        of = rows.groupBy("bucket").agg(F.collect_list("m").alias("g"), F.min("m.comp").alias("lo"), F.max("m.comp").alias("hi")).filter("lo <> hi")
        x, y = ([f"{side}.{w}" for w in self.words] for side in "xy")
        like = f"y.comp <> x.comp AND {alike(x, y, self.planes)} >= {self.agree}"
        pair = "struct(greatest(x.item, y.item) AS a, least(x.item, y.item) AS b)"
        return of.select(F.expr(f"inline(flatten(transform(g, (x, i) -> transform(filter(slice(g, i + 2, size(g)), y -> {like}), y -> {pair}))))"))

    def _crowd_links(self, rows: DataFrame) -> DataFrame | None:
        """Links in large buckets between items of their main component and others, or two others."""
        if rows.isEmpty():
            return None
        each = rows.groupBy("bucket", F.col("m.comp").alias("comp")).agg(F.count("*").alias("k"))
        top = F.max(F.struct("k", (-F.col("comp")).alias("least")))
        main = each.groupBy("bucket").agg(F.sum("k").alias("n"), F.count("*").alias("comps"), (-top["least"]).alias("main")).filter("comps > 1")
        main, a = self._write(main, "main")
        rows, several = rows.select("bucket", "m"), main.count()
        if several <= BROADCAST_IDS:  # few buckets still hold several components: most rows go before they are joined
            rows = pick(rows, "bucket", main.select(F.col("bucket").alias("item")), several)
        crowd = spread_join(rows, main, ["bucket"], "n", ["m.item"]).filter("main IS NOT NULL")
        family, b = self._write(self._sieved(crowd.select("main", "m.*")), "family")
        n = family.count()
        if not n:
            self.scratch.drop(a, b)
            return None
        whole, c = self._write(family.join(self.fetch(family.select("item"), n), "item").select("main", "item", "comp", "payload"), "whole")
        size, out = F.octet_length("payload").cast("bigint"), F.col("comp") != F.col("main")
        sizes, d = self._write(whole.groupBy("main").agg(F.count("*").alias("n"), F.ceil(F.sum(size) / BLOCK).alias("blocks"), F.ceil(F.sum(F.when(out, size)) / PROBES).alias("parts")), "sizes")
        to_set, percent = self.to_set, self.percent

        def compare(table: pa.Table) -> pa.Table:
            probe = table.column("probe").combine_chunks()
            found = block_links(table.filter(pc.invert(probe)), table.filter(probe), to_set, percent)
            return pa.table({"a": pa.array([p for p, _ in found], pa.int64()), "b": pa.array([q for _, q in found], pa.int64())})

        links, _ = self._write(self._dealt(whole, sizes).applyInArrow(compare, "a bigint, b bigint"), "links")
        self.scratch.drop(a, b, c, d)
        return links

    def _sieved(self, crowd: DataFrame) -> DataFrame:
        """Distinct (main, item, comp) of those of ``crowd`` (main, item, comp and sketch) that are alike to an item of another component of their main's crowd."""
        crowd, _ = self._write(crowd.distinct(), "crowd")
        out = F.col("comp") != F.col("main")
        sizes, _ = self._write(crowd.groupBy("main").agg(F.count("*").alias("n"), F.ceil(F.count("*") / SKETCHES).alias("blocks"), F.ceil(F.count(F.when(out, 1)) / SKETCHES).alias("parts")), "crowds")
        words, agree, planes = self.words, self.agree, self.planes

        def sieve(table: pa.Table) -> pa.Table:
            probe = table.column("probe").combine_chunks()
            sides = table.filter(pc.invert(probe)), table.filter(probe)
            seen = alike_rows(*sides, words, agree, planes)
            return pa.concat_tables([t.filter(pa.array(x)) for t, x in zip(sides, seen, strict=True)]).select(["main", "item", "comp"])

        return self._dealt(crowd, sizes).applyInArrow(sieve, "main bigint, item bigint, comp bigint").distinct()

    def _dealt(self, rows: DataFrame, sizes: DataFrame) -> GroupedData:
        """``rows`` (main, item, comp, ...) grouped so that all of a main's meet its outsiders, whose column probe is true, in blocks x parts; ``sizes``, written, has the number n, blocks and parts of each main."""

        def number(n: Column, salt: int) -> Column:
            return F.pmod(F.xxhash64("item", F.lit(salt)), n)

        def all_of(n: Column) -> Column:
            return F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))

        own = [c for c in rows.columns if c != "main"]
        rows = spread_join(rows, sizes, ["main"], "n", ["item"]).drop("n").filter("parts > 0 AND blocks > 0")
        blocks, parts = F.col("blocks"), F.col("parts")
        every = rows.select("main", number(blocks, 0).alias("block"), all_of(parts).alias("part"), F.lit(False).alias("probe"), *own)
        asked = rows.filter("comp <> main").select("main", all_of(blocks).alias("block"), number(parts, 1).alias("part"), F.lit(True).alias("probe"), *own)
        return every.union(asked).groupBy("main", "block", "part")


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * |x & y| >= percent * |x | y|, for sorted distinct elements."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)


def _matrix(sets: list[np.ndarray], elements: np.ndarray) -> np.ndarray:
    """A row of ones and zeros for each set: which of the sorted elements it has."""
    out = np.zeros((len(sets), len(elements)), dtype=np.float32)
    for i, s in enumerate(sets):
        s = s[np.searchsorted(s, elements[0]) : np.searchsorted(s, elements[-1], "right")]
        at = np.searchsorted(elements, s)
        out[i, at[elements[at] == s]] = 1
    return out


def _entries(sets: list[np.ndarray], elements: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, element) of every one of the sorted ``elements`` that a set holds, by their numbers and in the order of elements, and how many sets hold each."""
    x = np.concatenate(sets)
    at = np.minimum(np.searchsorted(elements, x), len(elements) - 1)
    held = elements[at] == x
    of, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[held], at[held]
    order = np.argsort(at, kind="stable")
    return of[order], at[order], np.bincount(at, minlength=len(elements))


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of ``a`` and each of ``b`` have in common, as a matrix."""
    out = np.zeros((len(a), len(b)), np.int64)
    elements = np.intersect1d(np.concatenate(a), np.concatenate(b))
    if not len(elements):
        return out
    (i, of_a, n_a), (j, of_b, n_b) = _entries(a, elements), _entries(b, elements)
    rare = RARE * n_a * n_b <= out.size
    often, columns = elements[~rare], max(1, CELLS // max(out.shape))
    for start in range(0, len(often), columns):
        some = often[start : start + columns]
        out += np.rint(_matrix(a, some) @ _matrix(b, some).T).astype(np.int64)
    i, of_a = i[rare[of_a]], of_a[rare[of_a]]
    first, n = np.cumsum(n_b) - n_b, n_b[of_a]
    ends, at = np.cumsum(n), 0
    while at < len(n):  # each entry of a meets those of b with its element
        stop = max(at + 1, int(np.searchsorted(ends, CELLS + (ends[at - 1] if at else 0), "right")))
        m = n[at:stop]
        nth = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        cells = np.repeat(i[at:stop] * len(b), m) + j[np.repeat(first[of_a[at:stop]], m) + nth]
        out += np.bincount(cells, minlength=out.size).reshape(out.shape)
        at = stop
    return out


def block_links(x: pa.Table, y: pa.Table, to_set: Callable, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks (item, comp, payload) whose components differ."""
    b = [to_set(p.as_py()) for p in y.column("payload")]
    if not b or not x.num_rows:
        return []
    nb, (yi, yc) = np.array([len(s) for s in b]), (y.column(c).to_numpy() for c in ("item", "comp"))
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            v = parent[v] = parent[parent[v]]
        return v

    out, step = [], max(1, CELLS // len(b))
    for part in (x.slice(at, step) for at in range(0, x.num_rows, step)):
        a = [to_set(p.as_py()) for p in part.column("payload")]
        na, (xi, xc) = np.array([len(s) for s in a]), (part.column(c).to_numpy() for c in ("item", "comp"))
        common = common_counts(a, b)
        ok = (100 * common >= percent * (na[:, None] + nb[None, :] - common)) & (na[:, None] > 0) & (nb[None, :] > 0) & (xc[:, None] != yc[None, :])
        for i, j in zip(*np.nonzero(ok), strict=True):
            p, q = int(xi[i]), int(yi[j])
            if (r := root(p)) != (s := root(q)):
                parent[r] = s
                out.append((p, q))
    return out
