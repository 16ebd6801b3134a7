"""Near-duplicates and line dedup against brute force."""

import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.llm import common, components, linededup, linking, neardup
from granary.llm.common import Scratch, spread_join
from granary.llm.components import connected_components, forest


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def word_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def alike(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def brute_groups(rows, k):
    sets = [(r[0], word_set(r[1], k)) for r in rows]
    real = [(i, s) for i, s in sets if i is not None]
    return roots({i for i, _ in real}, [(a, b) for (a, x), (b, y) in itertools.combinations(real, 2) if a == b or alike(x, y)]), sets


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, rows, k):
    want, sets = brute_groups(rows, k)
    got = [tuple(r) for r in neardup.near_duplicates(docs, words=k).collect()]
    expect = [(i, len(s), want.get(i), i is None or want[i] == i) for i, s in sets]
    assert sorted(got, key=repr) == sorted(expect, key=repr)


def test_keep_one(docs, rows):
    want, _ = brute_groups(rows, 5)
    out = neardup.keep_one(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({r for r in want.values()})
    assert sum(i is None for i in ids) == 2


def test_large_groups_and_chains(spark):
    """A chain whose ends are unlike, a large group of near copies, and a passage that many share."""
    base = [f"w{i}" for i in range(100)]
    chain = [" ".join(f"n{j}" if j < 3 * i else w for j, w in enumerate(base)) for i in range(12)]
    group = [" ".join([*base, f"x{i}"][::-1]) for i in range(80)]
    shared = [" ".join([*base[:30], *(f"u{i}_{j}" for j in range(60))]) for i in range(80)]
    rows = list(enumerate(chain + group + shared))
    want, _ = brute_groups(rows, 4)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_empty_table(none):
    assert neardup.near_duplicates(none).count() == 0
    assert neardup.keep_one(none).count() == 0
    assert linededup.line_groups(none).count() == 0
    assert linededup.dedup_lines(none).count() == 0


def brute_linker(spark, sets, percent, small):
    """Components of one bucket that holds all sets, without branching; sketches that say nothing."""
    frame = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "item long, payload binary")
    sketch = frame.selectExpr("item", "0L AS x1", "0L AS x2")
    linker = linking.Linker(Scratch(spark, "t"), lambda ids, n: linking.pick(frame, "item", ids, n), neardup._as_set, lambda p, q: neardup._links_of(p, q, percent), percent, sketch, 99, small)
    got = {r["id"]: r["component"] for r in linker.components(frame.selectExpr("1L AS bucket", "item")).collect()}
    return {i: got.get(i, i) for i in range(len(sets))}


def test_crowds_equal_brute_force(spark, monkeypatch):
    """Past its depth, the linker compares blocks: a bucket of several components, without branching."""
    monkeypatch.setattr(linking, "BLOCK", 8000)
    monkeypatch.setattr(linking, "PROBES", 3000)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(150)]
    pairs = [(a, b) for a, b in itertools.combinations(range(150), 2) if linking.linked(sets[a], sets[b], 60)]
    want = roots(range(150), pairs)
    assert brute_linker(spark, sets, 60, 8) == want and 1 < len(set(want.values())) < 150
    assert brute_linker(spark, sets, 60, 200) == want


def test_two_thousand_near_copies(spark):
    """A group whose texts lose a random part of one base: many pairs are links, many are not, and some documents link with none."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(w if rng.random() > rate else f"e{rng.integers(1 << 30)}" for w in base) for rate in rng.uniform(0, 0.07, 2000)]
    texts += ["some other text that is not like those at all"]
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=4).collect()
    index, sets = {}, []
    for t in texts:
        sets.append([index.setdefault(x, len(index)) for x in word_set(t, 4)])
    common = np.zeros((len(texts), len(texts)), np.int32)
    m = np.zeros((len(texts), len(index)), np.float32)
    for i, s in enumerate(sets):
        m[i, s] = 1
    common = np.rint(m @ m.T).astype(np.int64)
    n = np.array([len(s) for s in sets])
    a, b = np.nonzero(np.triu(100 * common >= 80 * (n[:, None] + n[None, :] - common), 1))
    want = roots(range(len(texts)), zip(a.tolist(), b.tolist()))
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert 2 < len(set(want.values())) < 1500


def test_spread_join_equals_join(spark, tmp_path):
    """Common, rare, missing and null keys."""
    rows = [(i, None if i % 50 == 0 else 1 if i % 3 else i % 40, i % 7) for i in range(3000)]
    named = {}
    for _, a, b in rows:
        if a is not None and a != 5:
            named[a, b] = named.get((a, b), 0) + 1
    left = spark.createDataFrame(rows, "x long, a long, b long")
    right = spark.createDataFrame([(a, b, n, f"{a}/{b}") for (a, b), n in named.items()], "a long, b long, n long, name string")
    for hot, most in ((100, 10), (100, 2), (10**6, 10)):
        got = sorted(tuple(r) for r in spread_join(left, right, ["a", "b"], "n", ["x"], hot, most).select("x", "name").collect())
        assert got == [(x, f"{a}/{b}" if (a, b) in named else None) for x, a, b in rows]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=80), st.integers(0, 3))
def test_forest(links, order):
    a, b = (np.array(x, np.int64) for x in zip(*links))
    u, r = forest(a, b, order)
    want = roots({x for p in links for x in p}, links)
    firsts = dict(zip(u.tolist(), r.tolist()))
    assert set(firsts) == set(want) and all(firsts[firsts[x]] == firsts[x] for x in firsts)
    assert all((firsts[x] == firsts[y]) == (want[x] == want[y]) for x in want for y in want)
    if not order:
        assert firsts == want


def test_components_of_a_long_chain(spark, monkeypatch):
    """A link a chunk, ids in the worst order: rounds with hashed orders end it."""
    monkeypatch.setattr(components, "CHUNK", 1)
    monkeypatch.setattr(components, "PLAIN", 1)
    links = [(i, i + 1) for i in range(40)]
    frame = spark.createDataFrame(links, "a long, b long").repartition(8)
    got = {r["id"]: r["component"] for r in connected_components(frame, Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(1, 41)}


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    want = roots({x for p in links for x in p}, links)
    assert got == {k: v for k, v in want.items() if k != v}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def brute_lines(rows):
    at = {}
    for doc, text, *_ in rows:
        for i, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\x0b\f\r"):
                at.setdefault(line.strip(" \t\x0b\f\r"), []).append((doc is None, doc, i))
    lines = sorted(at)
    sets = {x: {y[j : j + 8] for y in [x.ljust(8, "\0")] for j in range(len(y) - 7)} for x in lines}
    group = roots(range(len(lines)), [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if alike(sets[lines[a]], sets[lines[b]])])
    first = {}
    for k, x in enumerate(lines):
        for p in at[x]:
            first[group[k]] = min(first.get(group[k], (True, float("inf"), 0)), (p[0], -1 if p[1] is None else p[1], p[2]))
    return {(p[1], p[2], x): first[group[k]] for k, x in enumerate(lines) for p in at[x]}


def test_lines(docs, rows):
    want = brute_lines(rows)
    out = linededup.line_groups(docs).collect()
    assert len(out) == sum(bool(x.strip(" \t\x0b\f\r")) for r in rows for x in (r[1] or "").split("\n"))
    assert {(r["doc_id"], r["line_no"], r["first_doc_id"], r["first_line_no"]) for r in out} == {(d, i, None if f[0] else f[1], f[2]) for (d, i, _), f in want.items()}
    dedup = linededup.dedup_lines(docs)
    assert dedup.columns == docs.columns and dedup.count() == len(rows)
    kept = {(d, i) for (d, i, _), f in want.items() if (d, i) == (None if f[0] else f[1], f[2])}
    for r in dedup.collect():
        if r["doc_id"] == 100:
            assert r["text"] is None
        elif r["text"] and r["doc_id"] is not None and r["doc_id"] != 7:
            texts = (next(x[1] for x in rows if x[0] == r["doc_id"])).split("\n")
            assert [x for x in r["text"].split("\n") if x.strip(" \t\x0b\f\r")] == [x for i, x in enumerate(texts) if (r["doc_id"], i) in kept]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=6))
def test_shingle_hashes_stay_inside_lines(lines):
    h, first = linededup.shingle_hashes(lines)
    ends = [*first[1:], len(h)]
    for line, a, b in zip(lines, first, ends):
        assert set(h[a:b].tolist()) == set(linededup.shingle_hashes([line])[0].tolist())
        assert b - a == max(1, len(line) - 7)


def test_band_recall():
    rng = np.random.default_rng(0)
    hits = 0
    for _ in range(300):
        a = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 160))
        b = a[:146] + "".join(rng.choice(list("ABCDEFGH"), 14))
        hits += bool((linededup.bands([a])[0][0] == linededup.bands([b])[0][0]).any())
    assert hits >= 297


def test_query_keeps_near_lines_of_ordinary_length(spark, tmp_path):
    """One character changed in the middle of 60, two in 110; op1 and the pipeline's stage link them, unlike lines stay."""
    import corpus_pipeline

    one = "the quick brown fox jumps over the lazy dog by an old stone w"
    two = " ".join(f"{a}{b}" for a, b in zip("sun rain wind snow hail mist cloud storm frost thaw".split(), range(137, 9137, 900))) + " and some more words to fill this line"
    texts = [one, one.replace("jumps", "jumbs"), two, two.replace("hail", "haul").replace("some", "same"), "another line that has nothing to do with those above it here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["first_doc_id"] for r in linededup.op1_fuzzy_lines(spark, str(tmp_path)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    left = {r["doc_id"]: bool(r["text"]) for r in corpus_pipeline.drop_repeated_lines(spark, docs, str(tmp_path)).collect()}
    assert left == {0: True, 1: False, 2: True, 3: False, 4: True}


def test_rows_that_share_an_id_are_one_component(spark):
    """The classes of document 5 have smaller members 1 and 2; its blank rows stay."""
    texts = {1: "a b c d e f g h", 2: "p q r s t u v w"}
    rows = [(1, texts[1]), (2, texts[2]), (5, texts[1]), (5, texts[2]), (5, " "), (6, "quite another text than these")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(docs).filter("n_shingles > 0").collect()}
    assert got == {(1, 1), (2, 1), (5, 1), (6, 6)}
    assert sorted(tuple(r) for r in neardup.keep_one(docs).collect()) == [(1, texts[1]), (5, " "), (6, rows[5][1])]


def test_dense_nodes_are_compared_whole_and_not_branched(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (2, 2))
    rows = [(1, i, base[0]) for i in range(40)] + [(2, 100 + i, rng.integers(-(2**63), 2**63 - 1, 2)) for i in range(40)]
    sketch = spark.createDataFrame([(i, int(x[0]), int(x[1])) for _, i, x in rows], "item bigint, x1 bigint, x2 bigint")
    members = spark.createDataFrame([(b, i) for b, i, _ in rows], "bucket bigint, item bigint")
    linker = linking.Linker(Scratch(spark, "t"), None, None, None, 80, sketch, 99)
    split = linker._by_density(linker._shared(members))
    assert {(r["bucket"], r["dense"]) for r in split.collect()} == {(1, True), (2, False)}
    assert split.count() == 80


def test_density_of_buckets(spark):
    """Which large buckets are dense, by counts of bits, as by comparing every item with the bucket's pivots."""
    rng = random.Random(1)
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    bits, rows = {}, []
    for b in range(12):
        base = (rng.getrandbits(64), rng.getrandbits(64))
        items = range(len(bits), len(bits) + 40)
        for i in items:
            near = rng.random() < b / 12
            bits[i] = tuple((v if near else rng.getrandbits(64)) ^ (1 << rng.randrange(64)) for v in base)
        rows += [(b, i, 40, items[0], items[-1], items[7]) for i in items]
    scratch = Scratch(spark, "density")
    sketch = scratch.write(spark.createDataFrame([(i, *map(signed, x)) for i, x in bits.items()], "item long, x1 long, x2 long"), "sketch")
    large = scratch.write(spark.createDataFrame(rows, "bucket long, item long, n long, lo long, hi long, mid long"), "rows")
    got = linking.Linker(scratch, None, None, None, 80, sketch, 90)._by_density(large)
    assert got.count() == len(rows)

    def mean(mine, pivot):
        return sum(128 - sum((x ^ y).bit_count() for x, y in zip(bits[r[1]], bits[pivot], strict=True)) for r in mine) / len(mine)

    for r in got.select("bucket", "dense").distinct().collect():
        mine = [x for x in rows if x[0] == r["bucket"]]
        assert r["dense"] == (max(mean(mine, p) for p in mine[0][3:]) >= 64 * (1 + linking.DENSE))


def test_written_tables_leave_no_shuffle_files(spark):
    """The files of a shuffle go when its table is written, whenever the driver collects its garbage; the session's setting stays as it was."""
    jvm = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f for f in (str(x) for x in jvm.getAllFiles().mkString("\n").split("\n")) if "shuffle_" in f}

    before, setting = files(), spark.conf.get(common.FREED, None)
    table = Scratch(spark, "t").write(spark.range(50_000).selectExpr("id % 5000 AS k").groupBy("k").count(), "counts")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and table.count() == 5000
    assert spark.conf.get(common.FREED, None) == setting


def test_common_counts(monkeypatch):
    """Pair by pair, by matrices, and both, in small steps and at once; empty sets have nothing in common."""
    rng = np.random.default_rng(2)
    for cells, rare in itertools.product((40, 1 << 22), (0, 3, 256, 1 << 40)):
        monkeypatch.setattr(linking, "CELLS", cells)
        monkeypatch.setattr(linking, "RARE", rare)
        a, b = ([np.unique(rng.integers(0, 50, rng.integers(0, 25)).astype(np.uint64)) for _ in range(n)] for n in (17, 9))
        assert linking.common_counts(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def test_block_links_hold_bounded_matrices(monkeypatch):
    """Very many short lines fit a block: their counts are made for a few rows at a time, with the same components."""
    sizes, counts = [], linking.common_counts
    monkeypatch.setattr(linking, "common_counts", lambda a, b: sizes.append(len(a) * len(b)) or counts(a, b))
    monkeypatch.setattr(linking, "CELLS", 500)
    lines = [f"line {i % 37} of {i % 5}" for i in range(200)]
    block = pa.table({"item": range(200), "comp": range(200), "payload": lines})
    found = linking.block_links(block.slice(0, 150), block.slice(150), lambda x: linededup.line_set(x, 5), 80)
    links = [(i, j) for i in range(150) for j in range(150, 200) if linking.linked(linededup.line_set(lines[i], 5), linededup.line_set(lines[j], 5), 80)]
    assert roots(range(200), found) == roots(range(200), links) and max(sizes) <= 500


def test_rows_of_buckets_and_their_pivots(spark, monkeypatch):
    """Small, large and very large buckets, as by brute force; rows of very large ones are joined once, by their buckets' counts."""
    rng = random.Random(5)
    rows = [(b, i) for b, n in ((1, 3000), (2, 1200), (3, 40), (4, 7), (5, 2), (6, 1)) for i in rng.sample(range(10**6), n)]
    linker, plans = linking.Linker(Scratch(spark, "t"), None, None, None, 80, None, 99), {}
    write = linker._write
    monkeypatch.setattr(linker, "_write", lambda df, what: plans.update({what: df._jdf.queryExecution().optimizedPlan().toString()}) or write(df, what))
    members = linker.scratch.write(spark.createDataFrame(rows, "bucket long, item long"), "members")
    got = [tuple(r) for r in linker._shared(members).select("bucket", "item", "n", "lo", "hi", "mid").collect()]
    own = {b: [i for x, i in rows if x == b] for b in range(1, 7)}
    mids = {r["bucket"]: r["mid"] for r in members.groupBy("bucket").agg(F.min_by("item", F.xxhash64("item", F.pmod("bucket", F.lit(linking.ORDERS)))).alias("mid")).collect()}
    assert sorted(got) == sorted((b, i, len(x), min(x), max(x), mids[b] if len(x) > linker.small else None) for b, x in own.items() if len(x) > 1 for i in x)
    assert "Join Inner" not in "".join(plans.values()) and plans["shared"].count("Join") == 1


def test_rows_are_dealt_to_buckets_by_one_number(spark, monkeypatch):
    """Sorted by radix, which a second key rules out."""
    linker, plans = linking.Linker(Scratch(spark, "t"), None, None, None, 80, None, 99), {}
    write = linker._write
    monkeypatch.setattr(linker, "_write", lambda df, what: plans.update({what: df._jdf.queryExecution().sparkPlan().toString()}) or write(df, what))
    linker._shared(spark.createDataFrame([(1, 2), (1, 3), (4, 5)], "bucket long, item long"))
    keys = re.findall(r"Window \[.*\], \[([^\]]*)\]", plans["shared"])
    assert keys and all(re.fullmatch(r"deal#\d+L?", k) for k in keys)


def test_line_sets_cost_no_more_than_many_lines_at_once():
    """Blocks take lines one by one: no work of shingle_hashes on many lines is done for each of them."""
    lines = ["", "a", "abcd", "abcde", "the same words the same words \U0001f600"] + ["x" * n for n in range(3, 9)]
    for width in (5, 8):
        h, first = linededup.shingle_hashes(lines, width)
        for line, own in zip(lines, np.split(h, first[1:])):
            assert linededup.line_set(line, width).tolist() == sorted(set(own.tolist()))
    line, clock = " ".join(f"word{i}" for i in range(15)), time.process_time

    def took(f, *x):
        return min(-clock() + (f(*x), clock())[1] for _ in range(200))

    assert took(linededup.line_set, line, 5) < 0.8 * took(lambda: np.unique(linededup.shingle_hashes([line], 5)[0]))


def test_first_places_of_odd_ids(spark):
    """Ids at both ends of their range, negative and null ones, in order."""
    ids = [-(2**63), -(2**63) + 1, -10, -1, 0, 1, 9, 2**63 - 1, None]
    for k, first in enumerate(ids):
        docs = spark.createDataFrame([(d, "x\none line that all of these hold") for d in ids[k:][::-1]], "doc_id long, text string")
        got = linededup.line_groups(docs).filter("line_no = 1").collect()
        assert len(got) == len(ids) - k and all((r["first_doc_id"], r["first_line_no"], r["kept"]) == (first, 1, r["doc_id"] == first) for r in got)


def test_crowds_fetch_only_items_with_an_alike_one(spark, monkeypatch):
    """A large bucket of lines that are unlike, but for a few pairs: only those pairs' lines are fetched to be compared as a crowd, and no table stays."""
    monkeypatch.setattr(linking, "SKETCHES", 50)
    rng = random.Random(8)
    lines = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(120)) for _ in range(300)]
    for i in range(10, 20):
        lines[200 + i] = lines[i][:60] + "#" + lines[i][61:]
    frame = spark.createDataFrame(list(enumerate(lines)), "item long, payload string")
    words = linededup.bands(lines, 5)[1].view(np.int64)
    sketch = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(words.T)], ", ".join(["item long", *(f"{w} long" for w in linededup.WORDS)]))
    fetched = []

    def fetch(ids, n):
        fetched.append(ids.distinct().count())
        return linking.pick(frame, "item", ids, n)

    def linked(p, q):
        return linededup.links_of(p.to_pylist(), q.to_pylist(), 5, 80)

    scratch = Scratch(spark, "t")
    linker = linking.Linker(scratch, fetch, lambda x: linededup.line_set(x, 5), linked, 80, sketch, linededup.AGREE, 16, linededup.BANDS * linededup.ROWS)
    # The first bucket links two lines beforehand: without links there is no main component.
    members = frame.selectExpr("1L AS bucket", "item").union(frame.filter("item IN (10, 210)").selectExpr("2L AS bucket", "item"))
    got = {r["id"]: r["component"] for r in linker.components(members).collect()}
    assert got == {200 + i: i for i in range(10, 20)}
    assert sum(fetched) <= 40
    assert all(name.startswith("cc") for name in scratch.paths)


@pytest.mark.parametrize("planes", [0, 48])
def test_sketches_agree(spark, monkeypatch, planes):
    """The same by SQL, by arrays in steps, and by counting bits one by one."""
    monkeypatch.setattr(linking, "SEEN", 64)
    rng = random.Random(planes)
    words = ["x1", "x2", "x3"][: 3 if planes else 2]
    base = [rng.getrandbits(planes or 64) for _ in words]
    rows = [(i, rng.randrange(3), *(b ^ sum(1 << rng.randrange(planes or 64) for _ in range(rng.randrange(12))) & (2 ** (planes or 64) - 1) for b in base)) for i in range(40)]

    def agree(x, y):
        differ = [a ^ b for a, b in zip(x[2:], y[2:], strict=True)]
        return planes - (differ[0] | differ[1] | differ[2]).bit_count() if planes else 128 - sum(d.bit_count() for d in differ)

    least = sorted(agree(x, y) for x, y in itertools.combinations(rows, 2))[-60]
    signed = [(*r[:2], *(v - 2**64 if v >= 2**63 else v for v in r[2:])) for r in rows]
    table = pa.table({n: pa.array(c, pa.int64()) for n, c in zip(["item", "comp", *words], zip(*signed, strict=True), strict=True)})
    x, y = linking.alike_rows(table.slice(0, 25), table.slice(25), words, least, planes)
    near = [(a, b) for a in rows[:25] for b in rows[25:] if a[1] != b[1] and agree(a, b) >= least]
    assert near and set(np.flatnonzero(x)) == {a[0] for a, _ in near} and set(np.flatnonzero(y)) == {b[0] - 25 for _, b in near}
    frame = spark.createDataFrame(signed, ", ".join(f"{n} long" for n in ["item", "comp", *words]))
    sql = linking.alike([f"p.{w}" for w in words], [f"q.{w}" for w in words], planes)
    got = frame.alias("p").crossJoin(frame.alias("q")).selectExpr("p.item AS a", "q.item AS b", f"{sql} AS n").collect()
    assert all(r["n"] == agree(rows[r["a"]], rows[r["b"]]) for r in got) and len(got) == 1600
