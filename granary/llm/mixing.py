"""Mixing of sources to target weights, in fixed-length blocks of words.

Each source's documents form one stream of words, cut into blocks of ``block`` words. Targets
say how many blocks a source gives. The driver draws, shard by shard, a multinomial of the
places left to each source, so that the sum over shards is exact; the last shard takes what is
left. The k-th place of a source takes block ``perm(k mod n)`` of its n blocks, with a
keyed permutation for each pass over the source, so that passes use every block once. The last pass takes
whole blocks and a part of one, so that a source's words are its rounded target. Places
and blocks are joined by index. DataFrame functions only.

Any number of sources. Beyond ``MAX_GROUPS`` of them (a host or URL as the source) the driver
draws for groups of sources, dealt by rank: ranks, targets and block counts are then computed by
the plan, and a place of a group goes, by a keyed permutation of the group's places, to the source whose
run of places holds it. The driver holds one row a group and shards x groups counts, at most
``MAX_RUNS``; shards are at most ``MAX_SHARDS``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import WORD, Scratch, fresh, literal_table, spread_join

MAX_GROUPS = 1000
MAX_SHARDS = 4096
#: Rows of the driver's table of (shard, group) counts; large corpora of many groups get larger shards.
MAX_RUNS = 2**18
PLACES_PER_TASK = 250_000
#: Sources in one task of their ranking.
SOURCES_PER_TASK = 100_000
#: Places that are matched at once with the sources of a group that own some of them.
BIN = 64
#: Names of the plan's own columns; callers hand in columns of other names.
RESERVED = frozenset(("row_", "src_", "name_", "source_size", "target", "sums_", "sum_", "size_", "base_", "at_", "block", "start", "length", "within", "n", "k1_", "k2_", "rows"))
#: Rows of one running sum; a source has as many sums as it needs.
ROWS_PER_SUM = 5_000


def targets(sizes: list[int], weights: tuple[int, ...] = (1, 2, 3), most: float = 3) -> list[float]:
    """Words wanted of each source, in order: shares of all words by the repeating weights, at most ``most`` times a source's size.

    What is cut off is shared anew by weight among the sources below their limit, until none is above.
    """
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, full = [0.0] * len(sizes), [s == 0 for s in sizes]
    while True:
        left = sum(sizes) - sum(most * s for s, f in zip(sizes, full, strict=True) if f)
        share = sum(x for x, f in zip(w, full, strict=True) if not f)
        out = [most * s if f else left * x / share for s, x, f in zip(sizes, w, full, strict=True)]
        over = [i for i, s in enumerate(sizes) if not full[i] and out[i] > most * s]
        if not over:
            return [float(x) for x in out]
        for i in over:
            full[i] = True


def shard_counts(places: list[int], shards: int, seed: int) -> np.ndarray:
    """Places of each source in each shard: multinomial draws from what is left, row sums at most one apart, column sums exact."""
    rng = np.random.default_rng(seed)
    left = np.array(places, dtype=np.int64)
    total = int(left.sum())
    out = np.zeros((shards, len(places)), dtype=np.int64)
    for s in range(shards):
        want = total // shards + (s < total % shards)
        if s == shards - 1:
            out[s] = left
            break
        while want:
            got = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[s] += got
            left -= got
            want -= int(got.sum())
    return out


def permuted(i: Column, n: Column, step: Column, key: Column, wide: bool) -> Column:
    """A keyed permutation of 0 .. n-1: twice, rotate runs of indexes by a hash, then spread them by ``step`` (coprime to n)."""
    kind = "decimal(38,0)" if wide else "bigint"  # products of indexes above 2**31 leave 64 bits
    for salt, run in ((1, 61), (2, 977)):
        q = F.floor(i / run) if wide else (i - F.pmod(i, F.lit(run))) / run
        q = q.cast("bigint")
        size = F.least(F.lit(run).cast("bigint"), n - q * run)
        i = q * run + F.pmod(i - q * run + F.pmod(F.xxhash64(q, key, F.lit(salt)), size), size)
        i = F.pmod(i.cast(kind) * step.cast(kind) + F.pmod(F.xxhash64(key, F.lit(-salt)), n).cast(kind), n.cast(kind)).cast("bigint")
    return i


def coprime(n: int) -> int:
    """The first number from the golden section of n upward that shares no factor with n."""
    step = max(1, int(n * 0.6180339887498949))
    while math.gcd(step, n) != 1:
        step += 1
    return step


def coprime_of(n: Column) -> Column:
    """``coprime`` in a plan. Below 2**62 no number has so many prime factors that all of 128 numbers in turn share one."""

    def divisor(a: Column, b: Column) -> Column:
        step = F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b"))))
        return step["a"]

    first = F.greatest(F.lit(1).cast("bigint"), F.floor(n * 0.6180339887498949).cast("bigint"))
    none = F.lit(None).cast("bigint")
    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.lit(127).cast("bigint")), none, lambda got, i: F.when(got.isNotNull(), got).when(divisor(first + i, n) == 1, first + i))


def name_hashes(c: str, names: list[str]) -> list[Column]:
    return [F.xxhash64(F.col(c).isNull(), F.coalesce(c, F.lit("")), F.lit(i)).alias(n) for i, n in enumerate(names)]


SOURCE = "src_ bigint, name_ string, source_size bigint, target double, sums_ bigint, blocks bigint, passes bigint, rest bigint, part bigint, step bigint, part_step bigint, places bigint"


def few_sources(spark: SparkSession, found: list, weights: tuple[int, ...], most: float, block: int) -> tuple[DataFrame, list[int], int]:
    """Table ``SOURCE`` as a literal, the places of each source, and the most blocks of one."""
    found = sorted(found, key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [int(r["n"] or 0) for r in found]
    out = []
    for i, (r, s, t) in enumerate(zip(found, sizes, targets(sizes, weights, most) if sizes else [], strict=True)):
        blocks = -(-s // block)
        passes, rest = divmod(round(t), s) if s else (0, 0)
        part = blocks if rest > (blocks - 1) * block else max(0, blocks - 1)
        out.append((i, r[0], s, t, max(1, -(-int(r["rows"]) // ROWS_PER_SUM)), blocks, passes, rest, part, coprime(blocks), coprime(part), place_count(s, round(t), block)))
    return literal_table(spark, out, SOURCE), [r[-1] for r in out], max([0, *(r[5] for r in out)])


def many_sources(scratch: Scratch, found: DataFrame, weights: tuple[int, ...], most: float, block: int, groups: int) -> tuple[DataFrame, list[int], int]:
    """Table ``SOURCE`` with the columns rows, group_ and before_ (places of the group's earlier sources), written, the places of each group, and the most blocks of a source.

    The same targets as ``targets``: what the full sources leave is one number, found anew until no other source is full.
    """
    name = found.columns[0]
    found = scratch.write(found, "found")
    n, words = found.agg(F.count("*"), F.sum("n")).first()
    order = F.col(name).asc_nulls_last()
    dealt = scratch.write(found.repartitionByRange(max(1, -(-n // SOURCES_PER_TASK)), order).withColumn("at_", F.spark_partition_id()), "dealt")
    before = Window.orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)  # one row for so many sources
    bases = dealt.groupBy("at_").agg(F.count("*").alias("held")).select("at_", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base_"))
    src = dealt.join(F.broadcast(bases), "at_").withColumn("src_", F.row_number().over(Window.partitionBy("at_").orderBy(order)) + F.col("base_") - 1)
    size = F.coalesce("n", F.lit(0)).cast("bigint")
    w = F.array(*map(F.lit, weights))[F.pmod("src_", F.lit(len(weights))).cast("int")]
    ranked = scratch.write(src.select("src_", F.col(name).alias("name_"), size.alias("source_size"), F.col("rows").cast("bigint").alias("rows"), w.cast("double").alias("w")), "ranked")
    empty = F.col("source_size") == 0
    full, share, known = empty, F.lit(None).cast("double"), None
    while True:
        held, kept, left, weight = ranked.agg(F.count_if(full), F.sum(F.when(full, F.col("source_size"))), F.lit(words or 0) - F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)) * most, F.sum(F.when(~full, F.col("w")))).first()
        if held == known or not weight:
            break
        known, share = held, F.lit(float(left)) * F.col("w") / F.lit(float(weight))
        full = empty | (share > F.col("source_size") * most)  # shares only rise
    src = ranked.withColumn("target", F.when(full, (F.col("source_size") * most).cast("double")).otherwise(share))
    src = src.withColumns({"sums_": F.expr(f"(rows + {ROWS_PER_SUM - 1}) div {ROWS_PER_SUM}"), "blocks": F.expr(f"(source_size + {block - 1}) div {block}"), "want": F.bround("target").cast("bigint")})
    some = F.col("source_size") > 0
    src = src.withColumns({"passes": F.when(some, F.expr("want div source_size")).otherwise(0), "rest": F.when(some, F.col("want") % F.col("source_size")).otherwise(0)})
    src = src.withColumn("part", F.when(F.col("rest") > (F.col("blocks") - 1) * block, F.col("blocks")).otherwise(F.greatest(F.lit(0), F.col("blocks") - 1)))
    src = src.withColumns({"step": coprime_of(F.col("blocks")), "part_step": coprime_of(F.col("part")), "places": F.col("passes") * F.col("blocks") + F.expr(f"(rest + {block - 1}) div {block}"), "group_": F.pmod("src_", F.lit(groups)).cast("int")})
    earlier = Window.partitionBy("group_").orderBy("src_").rowsBetween(Window.unboundedPreceding, -1)
    src = src.withColumn("before_", F.coalesce(F.sum("places").over(earlier), F.lit(0)))
    src = scratch.write(src.selectExpr(*(f"cast({f.split()[0]} as {f.split()[1]}) as {f.split()[0]}" for f in SOURCE.split(", ")), "rows", "group_", "before_"), "sources")
    scratch.drop("found", "dealt", "ranked")
    counts = {r[0]: r[1:] for r in src.groupBy("group_").agg(F.sum("places"), F.max("blocks")).collect()}
    return src, [int(counts[g][0]) if g in counts else 0 for g in range(groups)], max(int(c[1]) for c in counts.values())


@dataclass
class Mix:
    """rows: row_ (long, unique), source_size, target and the input's columns. pieces: row_, src_, block, start, length (words), within (words of the block before it). places: shard, position, src_, pass_, block, cut (words that the place takes of its block, null: all)."""

    rows: DataFrame
    pieces: DataFrame
    places: DataFrame
    scratch: Scratch


def mix_blocks(df: DataFrame, size: str, source: str, order: list[str], block: int = 128, places_per_shard: int = 65_536, weights=(1, 2, 3), most: float = 3, seed: int = 29, max_groups: int = MAX_GROUPS) -> Mix:
    """Plan a mix of the rows of ``df``, whose column ``size`` counts words. Other columns than those named are not looked at.

    ``order``: columns that order a source's stream; rows equal in all of them are
    interchangeable, so a rerun on the same rows gives the same mix. Sources are taken by code
    point, null last. Rows of no words give nothing; a source of no words has target 0; an empty
    table gives an empty mix.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "mix")
    df = df.select(*dict.fromkeys([*order, size, source]))
    taken = sorted(c for c in df.columns if c.lower() in RESERVED)
    if taken:
        raise ValueError(f"rename columns {taken}: the plan has columns of these names")
    named = scratch.write(df.withColumn("row_", F.monotonically_increasing_id()), "rows")
    found = named.groupBy(source).agg(F.sum(size).alias("n"), F.count("*").alias("rows"))
    some = found.limit(max_groups + 1).collect()
    about = ["src_", "source_size", "target", "sums_"]
    if len(some) <= max_groups:
        src, places, most_blocks = few_sources(spark, some, weights, most, block)
        rows = named.join(F.broadcast(src.select("name_", *about)), named[source].eqNullSafe(F.col("name_"))).drop("name_")
    else:
        src, places, most_blocks = many_sources(scratch, found, weights, most, block, max_groups)
        # Hashes of 128 bits stand for names, so that rows of a common source are spread.
        keys = ["k1_", "k2_"]
        by = src.select(*name_hashes("name_", keys), "rows", *about)
        rows = spread_join(named.select("*", *name_hashes(source, keys)), by, keys, "rows", ["row_"]).drop(*keys, "rows")
    rows = rows.withColumn("sum_", F.pmod(F.xxhash64(*order), F.col("sums_")))

    own = Window.partitionBy("src_", "sum_").orderBy(*order, "row_")
    up_to = Window.partitionBy("src_").orderBy("sum_").rowsBetween(Window.unboundedPreceding, -1)
    some = rows.filter(F.col(size) > 0).select("row_", "src_", "sum_", F.col(size).cast("bigint").alias("size_"), *order)
    bases = some.groupBy("src_", "sum_").agg(F.sum("size_").alias("n")).select("src_", "sum_", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("base_"))
    at = some.withColumn("at_", F.sum("size_").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size_")).join(bases, ["src_", "sum_"])
    at = at.select("row_", "src_", "size_", (F.col("at_") + F.col("base_")).alias("at_"))
    cut = at.withColumn("block", F.explode(F.expr(f"sequence(at_ div {block}, (at_ + size_ - 1) div {block})")))
    first, last = F.greatest(F.col("block") * block, F.col("at_")), F.least((F.col("block") + 1) * block, F.col("at_") + F.col("size_"))
    pieces = cut.select("row_", "src_", "block", (first - F.col("at_")).alias("start"), (last - first).alias("length"), (first - F.col("block") * block).alias("within"))

    total = sum(places)
    shards = min(MAX_SHARDS, max(1, MAX_RUNS // max(1, len(places))), max(1, -(-total // places_per_shard)))
    counts = shard_counts(places, shards, seed) if total else np.zeros((0, len(places)), dtype=np.int64)
    runs, taken = [], [0] * len(places)
    for s, row in enumerate(counts):
        before, all_of = 0, int(row.sum())
        for i, c in enumerate(int(x) for x in row):
            if c:
                runs.append((s, i, taken[i], c, before, all_of, coprime(all_of), places[i], coprime(places[i])))
                taken[i], before = taken[i] + c, before + c
    runs = literal_table(spark, runs, "shard int, group_ int, first bigint, n bigint, before bigint, all_of bigint, stride bigint, of_group bigint, group_step bigint")
    wide = max([0, most_blocks, *places, *(int(r.sum()) for r in counts)]) >= 2**31
    k = runs.withColumn("from_", F.explode(F.expr("sequence(0L, n - 1, 10000L)"))).repartition(max(1, total // PLACES_PER_TASK), "shard", "group_", "from_").withColumn("k", F.explode(F.expr("sequence(from_, least(n, from_ + 10000) - 1)")))
    k = k.select("shard", "group_", "all_of", "stride", "of_group", "group_step", (F.col("first") + F.col("k")).alias("nth"), (F.col("before") + F.col("k")).alias("p_"))
    held = ["blocks", "passes", "rest", "part", "step", "part_step"]
    if "group_" in src.columns:
        k = k.withColumn("nth", permuted(F.col("nth"), F.col("of_group"), F.col("group_step"), F.xxhash64("group_", F.lit(seed + 2)), wide))
        # A bin holds BIN places of a group, and no more sources than that.
        bins = src.filter("places > 0").withColumn("bin_", F.explode(F.expr(f"sequence(before_ div {BIN}, (before_ + places - 1) div {BIN})")))
        bins = bins.select("group_", "bin_", "src_", "before_", "places", *held)
        k = k.withColumn("bin_", F.expr(f"nth div {BIN}")).hint("merge").join(bins, ["group_", "bin_"])
        k = k.filter("nth >= before_ AND nth < before_ + places").withColumn("nth", F.col("nth") - F.col("before_"))
    else:
        k = k.join(F.broadcast(src.select(F.col("src_").cast("int").alias("group_"), "src_", *held)), "group_")
    i = F.pmod("nth", "blocks")
    k = k.withColumns({"i_": i, "pass_": F.expr("nth div blocks")})
    # The last pass needs whole blocks only, if it can do without the short one; else it takes all blocks and cuts the short one.
    last = F.col("pass_") == F.col("passes")
    k = k.withColumns({"of_": F.when(last, F.col("part")).otherwise(F.col("blocks")), "by_": F.when(last, F.col("part_step")).otherwise(F.col("step"))})
    pick = permuted(F.col("i_"), F.col("of_"), F.col("by_"), F.xxhash64("src_", "pass_", F.lit(seed)), wide)
    place = permuted(F.col("p_"), F.col("all_of"), F.col("stride"), F.xxhash64("shard", F.lit(seed + 1)), wide)
    # Places grow with the input, but come from a small literal: without a hint they would be broadcast.
    k = k.select("shard", place.alias("position"), "src_", "pass_", pick.alias("block"), "i_", last.alias("last_"), "rest", "part", "blocks")
    cut_at = F.when(F.col("part") < F.col("blocks"), F.col("i_")).otherwise(F.col("block"))
    left = F.col("rest") - cut_at * block
    places = k.select("shard", "position", "src_", "pass_", "block", F.when(F.col("last_") & (left < block), left).alias("cut")).hint("merge")
    return Mix(rows.drop("sum_", "sums_"), pieces, places, scratch)


def place_count(size: int, target: int, block: int) -> int:
    """Blocks, whole or cut, that hold ``target`` words of a source of ``size``: all for each pass over it, then as many as the rest needs."""
    if not size:
        return 0
    passes, rest = divmod(target, size)
    return passes * -(-size // block) + -(-rest // block)


def part_of(length: Column, within: Column, cut: Column) -> Column:
    """Words that a place takes of a piece of its block."""
    return F.when(cut.isNull(), length).otherwise(F.greatest(F.least(length, cut - within), F.lit(0)))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_documents(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """The mixed corpus with the columns of ``df``: a row for each pass in which the mix takes words of a document.

    A document taken whole keeps its text as it is; else the text is the taken words, with the
    white space that follows each, and a column n_chars, if there, is counted anew. Null, empty
    and blank texts have no words and are never taken; texts of any length are cut only where blocks end. Repeated rows
    are each a document. Columns pass through whatever their names. An empty table gives an empty one.
    """
    size, key, nth = fresh(df, "size_w", "key_", "nth_")
    some = df.withColumn(size, word_count(F.col(text))).filter(F.col(size) > 0)
    some = some.withColumn(key, F.xxhash64(doc_id, text, source))
    # Rows equal in all three are told apart by their number; which is which makes no difference.
    some = some.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(doc_id)))
    plan = mix_blocks(some.select(F.col(doc_id).alias("doc_"), F.col(source).alias("source_"), F.col(size).alias("words_"), F.col(key).alias("key_"), F.col(nth).alias("nth_")), "words_", "source_", ["doc_", "words_", "key_", "nth_"], **options)
    times = plan.places.groupBy("src_", "block").agg(F.count_if(F.col("cut").isNull()).alias("times"), F.max("cut").alias("cut")).hint("merge")
    # A piece is taken whole in its first passes; in one more, what lies before the cut.
    both = F.array(
        F.struct("start", "length", F.lit(1).cast("bigint").alias("first"), F.col("times").alias("last")),
        F.struct("start", F.when(F.col("cut").isNull(), 0).otherwise(part_of(F.col("length"), F.col("within"), F.col("cut"))).alias("length"), (F.col("times") + 1).alias("first"), (F.col("times") + 1).alias("last")),
    )
    pieces = plan.pieces.join(times, ["src_", "block"]).select("row_", F.explode(both).alias("piece")).filter("piece.length > 0 AND piece.last >= piece.first")
    taken = pieces.groupBy("row_").agg(F.array_sort(F.collect_list("piece")).alias("taken_"))
    taken = taken.join(plan.rows.select("row_", F.col("key_").alias("tk_"), F.col("nth_").alias("tn_")), "row_").select("tk_", "tn_", "taken_")
    tk, tn, pass_, parts_ = fresh(some, "tk_", "tn_", "pass_", "taken_")
    out = some.join(taken.toDF(tk, tn, parts_), (F.col(key) == F.col(tk)) & (F.col(nth) == F.col(tn)))
    out = out.withColumn(pass_, F.explode(F.sequence(F.lit(1).cast("bigint"), F.array_max(F.transform(parts_, lambda p: p["last"])))))
    out = out.withColumn(parts_, F.filter(parts_, lambda p: (p["first"] <= F.col(pass_)) & (p["last"] >= F.col(pass_)))).filter(F.size(parts_) > 0)
    words = F.aggregate(parts_, F.lit(0).cast("bigint"), lambda a, p: a + p["length"])
    parts = F.regexp_extract_all(F.col(text), F.lit(WORD + "[\\x20\\x09-\\x0D]*"), F.lit(0))
    cut = F.array_join(F.transform(parts_, lambda p: F.array_join(F.slice(parts, (p["start"] + 1).cast("int"), p["length"].cast("int")), "")), "")
    out = out.withColumn(text, F.when(words == F.col(size), F.col(text)).otherwise(cut))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.length(text).cast(df.schema["n_chars"].dataType))
    return out.select(*df.columns)


def op6_block_mix(spark, sf_dir: str) -> DataFrame:
    """All documents mixed by source: how many words the mix takes of each, repeats counted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = mix_blocks(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "size", "source", ["doc_id", "size"])
    got = part_of(F.col("length"), F.col("within"), F.col("cut"))
    taken = plan.pieces.join(plan.places, ["src_", "block"]).groupBy("row_").agg(F.sum(got).alias("taken"))
    out = plan.rows.join(taken, "row_", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
