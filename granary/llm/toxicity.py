"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Labelled rows to learn from are a bounded sample (``Options.rows`` of each label, the smallest
by a hash of doc_id); corpus size changes neither the fit's time nor its memory. The fit is
sequential, with a rate for each coordinate, and L1 leaves few weights: those are sent to the
executors, which score every whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import fresh, release, released

#: ASCII other than letters and digits parts words.
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


@dataclass(frozen=True)
class Options:
    """bits: of the hash space. rows: learnt from, of each label. gaps: distances of word pairs (1: bigrams; more: skip-grams). stem: also the first letters of longer words, as a word of their own."""

    bits: int = 22
    rows: int = 5_000
    gaps: tuple[int, ...] = (1, 2)
    stem: int = 5
    epochs: int = 3
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 1.0


def features(text: str, o: Options) -> np.ndarray:
    """Distinct hashed features of a whole text."""
    words = text.lower().encode("utf-8", "replace").translate(_TABLE).split()
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    parts = [h]
    if o.stem:
        cut = [w[: o.stem] for w in words if len(w) > o.stem]
        parts.append(np.fromiter(map(zlib.crc32, cut), np.uint64, len(cut)) + np.uint64(1 << 40))
    for g in o.gaps:
        if len(h) > g:
            parts.append(h[:-g] * np.uint64(0x9E3779B97F4A7C15) + h[g:] + np.uint64(g << 41))
    x = np.concatenate(parts)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x >>= np.uint64(64 - o.bits)
    return x.astype(np.uint32)


@dataclass
class Model:
    """Sparse weights: sorted feature numbers and their weights; at most 2**bits, in practice thousands."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    options: Options

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.options.bits, dtype=np.float32)
        w[self.index] = self.weight
        return w


def squeezed(x: np.ndarray) -> bytes:
    """Sorted features as compressed differences, a few bits each."""
    return zlib.compress(np.diff(x, prepend=np.uint32(0)).astype("<u4").tobytes(), 1)


def spread(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<u4"), dtype=np.uint32)


def fit(texts: list[str], toxic: list[int], o: Options = Options(), seed: int = 5) -> Model:
    """``fit_features`` of whole texts."""
    return fit_features([squeezed(np.unique(features(t, o))) for t in texts], toxic, o, seed)


def fit_features(rows: list[bytes], toxic: list[int], o: Options = Options(), seed: int = 5) -> Model:
    """FTRL-proximal on rows of ``squeezed`` distinct features, a pass for each epoch in a random order. No rows: no weights, and a bias that says clean.

    A gradient is under 1, so a feature of at most l1 / epochs rows never passes the L1 bound: its weight
    is 0 all along, and it is left out. State is held for the others, not for the whole hash space.
    """
    count = np.zeros(1 << o.bits, np.int32)
    for r in rows:
        count[spread(r)] += 1
    known = np.flatnonzero(count > int(o.l1 / o.epochs))
    place = np.full(1 << o.bits, -1, np.int32)
    place[known] = np.arange(len(known), dtype=np.int32)
    del count
    xs = [(x := place[spread(r)])[x >= 0] for r in rows]
    del place
    z, n = np.zeros(len(known)), np.zeros(len(known))
    zb = nb = 0.0
    rng = np.random.default_rng(seed)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= o.l1, 0.0, (np.sign(zi) * o.l1 - zi) / ((o.beta + np.sqrt(ni)) / o.alpha + o.l2))

    for _ in range(o.epochs):
        for i in rng.permutation(len(xs)):
            x = xs[i]
            zi, ni = z[x], n[x]
            w = weights(zi, ni)
            wb = -zb / ((o.beta + nb**0.5) / o.alpha)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -35, 35)))
            g = p - toxic[i]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / o.alpha
            z[x], n[x] = zi + g - sigma * w, ni + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / o.alpha * wb
            nb += g * g
    bias = -zb / ((o.beta + nb**0.5) / o.alpha) if rows else -4.0
    w = weights(z, n)
    some = np.flatnonzero(w)
    return Model(known[some].astype(np.uint32), w[some].astype(np.float32), float(bias), o)


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of doc_id as text, mod 5, is 0. A null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, o: Options = Options()) -> Model:
    """Fit on at most ``o.rows`` labelled rows of each label that are not held out.

    Rows with a null doc_id or label are left out; of repeated labels of a doc_id the largest counts. doc_id is a whole number.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(o.rows) for y in (0, 1)]
    sample = by_hash[0].unionByName(by_hash[1])
    # 2 * o.rows pairs of numbers at most, so the texts are not shuffled. Of their texts only hashed features come to the driver.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([squeezed(np.unique(features(t.as_py() or "", o))) for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), found, batch.column(2)], ["doc_id", "found", "toxic"])

    rows = rows.select(F.col("doc_id").cast("bigint"), "text", F.col("toxic").cast("int")).mapInArrow(released(hashed), "doc_id bigint, found binary, toxic int").toArrow()
    found, toxic = rows["found"].to_pylist(), rows["toxic"].to_pylist()
    # Of rows that share a doc_id, one counts: the least by its features.
    least: dict[int, int] = {}
    for i, d in enumerate(rows["doc_id"].to_pylist()):
        if d not in least or found[i] < found[least[d]]:
            least[d] = i
    del rows
    order = [least[d] for d in sorted(least)]
    found, toxic = [found[i] for i in order], [toxic[i] for i in order]
    del least, order
    model = fit_features(found, toxic, o)
    del found, toxic
    release()  # the driver lives on through the later stages, and would keep what the fit took
    return model


_dense: dict[int, np.ndarray] = {}


def score(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with a score (double, 0 to 1) and a prediction (int). A null text scores as an empty one: the bias alone.

    Whole texts are scored, of any length; repeated rows each get their score; an empty table stays empty.

    Columns of ``docs`` that have those names are replaced; all others pass through.
    """
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType(), False), T.StructField(names[1], T.IntegerType(), False)])
    at = docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        key = zlib.crc32(m.index.tobytes() + m.weight.tobytes())
        if key not in _dense:
            _dense.clear()
            _dense[key] = m.dense()
        w, o = _dense[key], m.options
        for batch in batches:
            out = np.empty(batch.num_rows)
            for i, t in enumerate(batch.column(at)):
                x = features(t.as_py() or "", o)
                hit = x[w[x] != 0]
                out[i] = w[np.unique(hit)].sum(dtype=np.float64) + m.bias
            p = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=schema.names)

    return docs.mapInArrow(released(run), schema)


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't call toxic, with their columns."""
    names = fresh(docs, "score", "predicted")
    return score(docs, model, text, tuple(names)).filter(F.col(names[1]) == 0).select(*docs.columns)


def op3_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score and prediction by weights learnt from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
