"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set is its distinct word shingles. Documents of equal sets are one class, so
copies cost nothing. A class has ``TOKENS`` minwise tokens (place, least hash). In each of
``TREES`` independent trees it starts at the root and goes on to the child of each token that a
hash of (tree, path, token) selects, with probability 1 / (0.8 * TOKENS): about 1.25 children, and a
pair of similarity 0.8 shares one on average. Small nodes are compared exhaustively, and so are large ones whose
classes are much alike on average, which branching can't part; other large ones are branched further. A pair at the threshold is missed by all 16 trees with probability 1e-7 where
one level is enough, 4e-5 with two, 5e-4 with three. Candidates are checked by 128 one-bit minwise
hashes (a true pair is lost with probability 1e-6), then by the full sets.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import WORD, Scratch, mix, released, spread_join
from granary.llm.components import connected_components
from granary.llm.linking import BROADCAST_IDS, Linker, linked, pick

TOKENS, TREES, DEPTH = 128, 16, 4
#: Of 128 one-bit hashes; pairs of similarity 0.8 agree in 115 on average, 3.4 being the standard deviation.
AGREE = 99

_rng = np.random.default_rng(20_231)
_A = (_rng.integers(0, 2**32, TOKENS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 2**32, TOKENS, dtype=np.uint64).astype(np.uint32)
_ROOTS = _rng.integers(0, 2**63, TREES, dtype=np.uint64)
_PLACE = _rng.integers(0, 2**63, TOKENS, dtype=np.uint64)


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words; a shorter text is one run; no words, no run."""
    parts = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    n = len(parts)
    if not n:
        return np.zeros(0, np.uint64)
    if n < words:
        return np.frombuffer(hashlib.blake2b(b"\x00short " + b" ".join(parts), digest_size=8).digest(), "<u8")
    # Two 32-bit checksums of different kinds make a word's 64 bits.
    h = np.fromiter(map(zlib.crc32, parts), np.uint64, n) << np.uint64(32) | np.fromiter(map(zlib.adler32, parts), np.uint64, n)
    h = mix(h + np.uint64(0x9E3779B97F4A7C15))
    m = n - words + 1
    x = h[:m].copy()
    for i in range(1, words):
        x = mix(x * np.uint64(0xD6E8FEB86659FD93) + h[i : i + m])
    return np.unique(x)


def minwise(s: np.ndarray) -> np.ndarray:
    """The least of each of TOKENS hashes over the set, uint32."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        out = np.minimum(out, (x[at : at + 4096, None] * _A[None, :] + _B[None, :]).min(axis=0))
    return out


def children(paths: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row's path and minwise tokens, the children it goes on to: (row, child path)."""
    token = mix(tokens.astype(np.uint64) + _PLACE[None, :])
    x = mix(token + mix(paths)[:, None])
    row, place = np.nonzero(x < np.uint64(int(2**64 / (0.8 * TOKENS))))
    return row, mix(x[row, place] + np.uint64(1)).view(np.int64)


def low_bits(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest bit of each of 128 tokens, after mixing, as two longs."""
    two = np.packbits((mix(tokens.astype(np.uint64)) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
    return two[:, 0], two[:, 1]


def sketches(df: DataFrame, text: str, doc_id: str, words: int) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, tokens): k1 and k2 are a 128-bit digest of the set, tokens its minwise hashes; all null for empty sets."""
    schema = "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, tokens binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, tokens = [], [], [], []
            for t in batch.column(1):
                s = shingles(t.as_py() or "", words)
                a, b = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist() if len(s) else (None, None)
                n.append(len(s))
                k1.append(a)
                k2.append(b)
                tokens.append(minwise(s).tobytes() if len(s) else None)
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, k1, k2)), pa.array(tokens, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "k1", "k2", "tokens"])

    return df.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(released(run), schema)


def _start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, tokens) to (item, buckets, x1, x2): the buckets at the first level of all trees, and the sketch."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            t = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, TOKENS)
            rows, paths = (np.concatenate(x) for x in zip(*(children(np.full(len(t), r, np.uint64), t) for r in _ROOTS), strict=True))
            order = np.argsort(rows, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(t)))])
            buckets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(paths[order]))
            yield pa.RecordBatch.from_arrays([part.column(0), buckets, *map(pa.array, low_bits(t))], ["item", "buckets", "x1", "x2"])


def _go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, item, tokens) to (bucket, item) one level below."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            t = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint32).reshape(-1, TOKENS)
            row, path = children(part.column(0).to_numpy(zero_copy_only=False).view(np.uint64), t)
            yield pa.RecordBatch.from_arrays([pa.array(path), part.column(1).take(pa.array(row))], ["bucket", "item"])


def _as_set(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, np.uint64)


def _links_of(p: pa.Array, q: pa.Array, percent: int) -> list[bool]:
    return [linked(*(np.frombuffer(s.as_buffer(), np.uint64) for s in two), percent) for two in zip(p, q, strict=True)]


def _grouped(df: DataFrame, text: str, doc_id: str, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``df``."""
    sig = scratch.write(sketches(df, text, doc_id, words), "sketches")
    real = sig.filter("k1 IS NOT NULL AND doc_id IS NOT NULL")
    classes = real.groupBy("k1", "k2", "tokens").agg(F.min("doc_id").alias("item"), F.count("*").alias("n"))
    classes = scratch.write(classes, "classes")

    def fetch(ids: DataFrame, n: int) -> DataFrame:
        rows = pick(df.select(F.col(doc_id).cast("bigint").alias("item"), F.col(text).alias("text")), "item", ids, n)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = pa.array([shingles(t.as_py() or "", words).tobytes() for t in batch.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["item", "payload"])

        return rows.mapInArrow(released(run), "item bigint, payload binary")

    def branch(members: DataFrame) -> DataFrame:
        return members.join(classes.select("item", "tokens"), "item").select("bucket", "item", "tokens").mapInArrow(_go_on, "bucket bigint, item bigint")

    signed = classes.select("item", "tokens").mapInArrow(released(_start), "item bigint, buckets array<bigint>, x1 bigint, x2 bigint")
    signed = scratch.write(signed, "signed")
    linker = Linker(scratch, fetch, _as_set, lambda p, q: _links_of(p, q, percent), percent, signed.select("item", "x1", "x2"), AGREE)
    found = linker.components(signed.select(F.explode("buckets").alias("bucket"), "item"), branch, DEPTH)
    # Rows that share a doc_id are one document: it joins its classes, and its rows without words belong to it.
    per = sig.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows"), F.count("k1").alias("filled"), F.min("k1").alias("lo"), F.max("k1").alias("hi"), F.min_by("k2", "k1").alias("k2"))
    shared = scratch.write(per.filter("rows > 1 AND (lo <> hi OR filled BETWEEN 1 AND rows - 1)").select(F.col("doc_id").alias("item"), F.col("lo").alias("k1"), "k2"), "shared")
    n = shared.count()
    if n:
        items = pick(real.select("doc_id", "k1", "k2"), "doc_id", shared.select("item"), n).join(classes.select("k1", "k2", "item"), ["k1", "k2"])
        links = items.select(F.col("doc_id").alias("a"), F.col("item").alias("b"))
        found = connected_components(found.toDF("a", "b").union(links), scratch, "joined")
    heads = classes.select("k1", "k2", "n", "item").join(found, classes["item"] == found["id"], "left")
    heads = scratch.write(heads.select("k1", "k2", "n", F.coalesce("component", "item").alias("head")), "heads")
    scratch.drop("classes", "signed")
    rows = spread_join(sig.drop("tokens"), heads, ["k1", "k2"], "n", ["doc_id"])
    rows = rows.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("head", "doc_id")))
    if n:
        theirs = shared.join(heads.select("k1", "k2", F.col("head").alias("theirs")), ["k1", "k2"]).select(F.col("item").alias("doc_id"), "theirs")
        rows = rows.join(theirs, "doc_id", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("theirs", "component_id")))
    return rows.select("doc_id", "n_shingles", "component_id")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``df``.

    component_id: the smallest doc_id reachable through links (100 * intersection >= percent *
    union, on full sets), itself included; kept: doc_id is that. Null, empty and blank texts
    have no shingles and link with nothing. Rows that share a doc_id count as one document and
    get one component; rows of null doc_id link with nothing, have a null component and are
    kept. Texts of any length are compared whole. An empty table gives an empty result; columns
    other than the two named are not looked at.
    """
    rows = _grouped(df, text, doc_id, words, percent, Scratch(df.sparkSession, "near"))
    kept = F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))
    return rows.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """``df`` with one document of each near-duplicate group, that of the smallest doc_id; one of the rows that share a doc_id.

    Rows of null doc_id and of texts without words all stay. An empty table stays empty; all columns pass through.
    """
    scratch = Scratch(df.sparkSession, "keep")
    rows = _grouped(df, text, doc_id, words, percent, scratch).filter("n_shingles > 0 AND doc_id IS NOT NULL")
    per = rows.groupBy("doc_id").agg(F.min("component_id").alias("head"), F.count("*").alias("rows")).filter("head <> doc_id OR rows > 1")
    odd = scratch.write(per.select(F.col("doc_id").alias("item"), (F.col("head") == F.col("doc_id")).alias("kept")), "odd")
    scratch.drop("sketches", "heads")
    key, filled = df[doc_id].cast("bigint"), F.coalesce(F.col(text), F.lit("")).rlike(WORD)
    n, twice = odd.count(), odd.filter("kept")
    out = df.join(F.broadcast(odd) if n <= BROADCAST_IDS else odd, (key == odd["item"]) & filled, "left_anti")
    if twice.isEmpty():
        return out
    return out.unionByName(pick(df.filter(filled), doc_id, twice.select("item")).dropDuplicates([doc_id]))


def op9_chosen_path(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents, by 4-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)
