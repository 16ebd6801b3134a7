"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, union-find.

Equal lines are one class. Each class gets ``BANDS`` bands of ``ROWS`` minwise hashes of its
distinct character shingles; lines of similarity 0.8 share a band with probability 0.998,
of 0.9 with 0.99999. Candidates are verified by their whole shingle sets and joined to
components; of each component, the line that comes first (by doc_id, then line number) stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Scratch, fresh, mix, released, spread_join
from granary.llm.linking import Linker, pick

#: Characters of a shingle unless told otherwise: unrelated lines of equal length share under 1 % of such shingles.
SHINGLE = 8
#: Of the query and the pipeline: lines stay near with one changed character from 49 characters on (from 79 with eight), with two from 94 (151).
NEAR_SHINGLE = 5
BANDS, ROWS = 12, 4
#: A sketch has so many bits of each minwise hash. Lines of similarity 0.8 agree in all bits of 39.6 of the 48 hashes on average, 2.6 being the standard deviation;
#: unrelated ones share 8 hashes at the median where they share a bucket of check_l, and so agree in some 13.
PLANES, AGREE = 3, 27
#: Lines of a bucket whose pairs are all looked at, by their sketches.
SMALL = 256
#: Characters hashed at a time; their hashes stay in a core's cache.
CHUNK = 1 << 16

_rng = np.random.default_rng(7_919)
_A = (_rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_BAND = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


def _rolled(text: str, width: int) -> np.ndarray:
    """A number for every ``width`` characters in turn of the text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    h = c
    for i in range(1, width):  # one character more
        h = h[:-1] * _P + c[i:]
    return h


def shingle_hashes(lines: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all character shingles of the lines, and each line's first; a line shorter than a shingle is padded to one."""
    padded = [s if len(s) >= width else s + "\x00" * (width - len(s)) for s in lines]
    h = _rolled("".join(padded), width)  # those across line ends are dropped below
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    count = size - width + 1
    ends = np.cumsum(size)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    at = np.arange(int(count.sum())) + np.repeat(ends - size - first, count)
    return mix(h[at]), first


def _distinct(x: np.ndarray) -> np.ndarray:
    """Of a sorted array that isn't empty."""
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def line_set(line: str, width: int = SHINGLE) -> np.ndarray:
    """The line's shingles: the distinct ones of ``shingle_hashes``, without what that does for many lines."""
    return _distinct(np.sort(mix(_rolled(line.ljust(width, "\x00"), width))))


def links_of(p: list[str], q: list[str], width: int, percent: int) -> np.ndarray:
    """Which pairs of lines, up to 1024 of them, have 100 * intersection >= ``percent`` * union of their shingles. A shingle's key is its pair, 53 bits of its hash and whose it is, so all lines are sorted at once."""
    if not p:
        return np.zeros(0, bool)
    h, first = shingle_hashes([*p, *q], width)
    line = np.arange(2 * len(p), dtype=np.uint64)
    key = line % np.uint64(len(p)) << np.uint64(54) | line // np.uint64(len(p))
    x = h >> np.uint64(11) << np.uint64(1)
    x |= np.repeat(key, np.diff(np.append(first, len(h))))
    x.sort()
    x = _distinct(x)
    common = x[1:][(x[1:] ^ x[:-1]) == 1]  # equal but for whose it is

    def count(x: np.ndarray) -> np.ndarray:
        return np.bincount((x >> np.uint64(54)).astype(np.int64), minlength=len(p))

    n = count(common)
    return 100 * n >= percent * (count(x) - n)


def bands(lines: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(lines, BANDS) bucket numbers, and (PLANES, lines) words of the sketch: the lowest bits of the minwise hashes, their second ones, and so on."""
    least = np.empty((BANDS * ROWS, len(lines)), np.uint32)
    start = 0
    while start < len(lines):
        stop, chars = start, 0
        while stop < len(lines) and (stop == start or chars + len(lines[stop]) <= CHUNK):
            chars += len(lines[stop]) + width
            stop += 1
        h, first = shingle_hashes(lines[start:stop], width)
        x = (h >> np.uint64(32)).astype(np.uint32)
        y = np.empty_like(x)
        for r in range(BANDS * ROWS):
            np.multiply(x, _A[r], out=y)
            np.add(y, _B[r], out=y)
            np.minimum.reduceat(y, first, out=least[r, start:stop])
        start = stop
    out = np.empty((len(lines), BANDS), np.uint64)
    sketch = np.zeros((PLANES, len(lines)), np.uint64)
    for band in range(BANDS):
        key = np.full(len(lines), _BAND[band], np.uint64)
        for r in range(band * ROWS, (band + 1) * ROWS):
            key = mix(key + least[r])
            bit = mix(least[r].astype(np.uint64) + _BAND[0])
            for plane in range(PLANES):
                sketch[plane] |= (bit >> np.uint64(plane) & np.uint64(1)) << np.uint64(r)
        out[:, band] = key
    return out, sketch


#: Names of a sketch's words.
WORDS = [f"x{p + 1}" for p in range(PLANES)]


def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(item, line) to (item, buckets, x1, ...)."""
    for batch in batches:
        lines = batch.column(1).to_pylist()
        if lines:
            keys, sketch = (x.view(np.int64) for x in bands(lines, width))
            ends = pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(keys.ravel())), *map(pa.array, sketch)], ["item", "buckets", *WORDS])


def _trimmed(c: Column) -> Column:
    """Without ASCII white space at the ends; a pattern for that would try every run of blanks inside."""
    return F.trim(c, F.lit(" \t\n\x0b\f\r"))


#: Rows of one place in the order of (doc_id, line_no) are told apart by this many values of a hash of their text.
TIES = 10**8


#: One number orders (doc_id, line_no, tie): 20, 10 and 8 digits. Numbers are aggregated without sorting, structs are not.
#: A doc_id's digits are 2 for null, else 1, or 0 if it's negative, and its lower 63 bits. This is a row's share of the number.
PLACE = """CAST(CASE WHEN doc_id IS NULL THEN 20000000000000000000BD
    ELSE CAST(CAST(doc_id AS BIGINT) & 9223372036854775807L AS DECIMAL(20)) + CASE WHEN doc_id < 0 THEN 0BD ELSE 10000000000000000000BD END
    END * 1000000000000000000BD + tie AS DECIMAL(38))"""


def _lines(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, r1, r2, place, tie, line_no, line) of every line that isn't blank; (r1, r2) is a digest of the row's doc_id and text."""
    # Once a row: what stands beside a generator is computed for each of its rows.
    rows = df.select(F.col(doc_id).alias("doc_id"), *(c.alias(n) for c, n in zip(_row_key(text, doc_id), ("r1", "r2"), strict=True)), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("parts"))
    rows = rows.withColumn("tie", F.pmod("r1", F.lit(TIES))).withColumn("place", F.expr(PLACE))
    rows = rows.select("doc_id", "r1", "r2", "place", "tie", F.posexplode("parts").alias("line_no", "line"))
    return rows.withColumn("line", _trimmed(F.col("line"))).filter("line <> ''")


def _row_key(text: str, doc_id: str) -> tuple[Column, Column]:
    # A seed of its own makes the second word independent; null doc_ids have a number of their own.
    return tuple(F.xxhash64(F.lit(seed), F.col(doc_id).isNull(), doc_id, text) for seed in (1, 2))


def _key(line: Column) -> tuple[Column, Column]:
    """A 128-bit digest of a line, as two longs."""
    return F.xxhash64(F.lit(1), line), F.xxhash64(F.lit(2), line)


def _grouped(df: DataFrame, text: str, doc_id: str, percent: int, shingle: int, scratch: Scratch) -> DataFrame:
    """(doc_id, r1, r2, line_no, k1, k2, first_doc_id, first_line_no, kept) of every line that isn't blank."""
    lines = _lines(df, text, doc_id)
    place = F.expr("CAST(place + CAST(line_no AS BIGINT) * 100000000L AS DECIMAL(38))")
    classes = lines.groupBy("line").agg(F.min(place).alias("at"), F.count("*").alias("n"))
    classes = scratch.write(classes.withColumn("item", F.monotonically_increasing_id()), "classes")
    signed = classes.select("item", "line").mapInArrow(released(lambda batches: _sign(batches, shingle)), ", ".join(["item bigint", "buckets array<bigint>", *(f"{w} bigint" for w in WORDS)]))
    signed = scratch.write(signed, "signed")

    def fetch(ids: DataFrame, n: int) -> DataFrame:
        return pick(classes.select("item", F.col("line").alias("payload")), "item", ids, n)

    def linked(p: pa.Array, q: pa.Array) -> np.ndarray:
        return links_of(p.to_pylist(), q.to_pylist(), shingle, percent)

    linker = Linker(scratch, fetch, lambda line: line_set(line, shingle), linked, percent, signed.select("item", *WORDS), AGREE, small=SMALL, planes=BANDS * ROWS)
    found = linker.components(signed.select(F.explode("buckets").alias("bucket"), "item"))
    scratch.drop("signed")
    # Only linked lines need their component's first; a component's own number is one of its lines.
    ids = found.union(found.select("component", "component").distinct())
    heads = ids.join(classes.select(F.col("item").alias("id"), "at"), "id")
    heads = scratch.write(heads.groupBy("component").agg(F.min("at").alias("head"), F.count("*").alias("size")), "first")
    heads = scratch.write(spread_join(ids, heads, ["component"], "size", ["id"]).select(F.col("id").alias("item"), "head"), "heads")
    k1, k2 = _key(F.col("line"))
    named = classes.select(k1.alias("k1"), k2.alias("k2"), "n", "item", "at").join(heads, "item", "left").withColumn("head", F.coalesce("head", "at"))
    digits = F.lpad(F.col("head").cast("string"), 38, "0")
    sign, doc = F.substring(digits, 1, 1), F.substring(digits, 2, 19).cast("bigint")
    doc = F.when(sign == "1", doc).when(sign == "0", doc.bitwiseOR(F.expr("shiftleft(1L, 63)")))
    named = named.select("k1", "k2", "n", doc.alias("first_doc_id"), F.substring(digits, 21, 10).cast("int").alias("first_line_no"), F.substring(digits, 31, 8).cast("bigint").alias("first_tie"))
    named = scratch.write(named, "named")
    scratch.drop("classes", "heads", "first")
    k1, k2 = _key(F.col("line"))
    out = spread_join(lines.select("doc_id", "r1", "r2", "tie", "line_no", k1.alias("k1"), k2.alias("k2")), named, ["k1", "k2"], "n", ["doc_id", "line_no"])
    kept = F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.col("line_no") == F.col("first_line_no")) & (F.col("tie") == F.col("first_tie"))
    return out.select("doc_id", "r1", "r2", "line_no", "k1", "k2", "first_doc_id", "first_line_no", kept.alias("kept"))


def line_groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, line_no, line_key, first_doc_id, first_line_no, kept) for every line of every text that isn't blank.

    Lines end at a line feed and are compared without white space at their ends. line_no counts
    from 0. kept: the line is its component's first, by (doc_id, line_no), null doc_ids last, then by a hash of the
    text. Rows equal in doc_id and text count as one document: a line kept in one is kept in each. Null, empty
    and blank texts have no lines; lines of any length are compared whole. line_key names the line's text (128-bit
    digest). shingle: characters of the shingles that lines are compared by. doc_id is a whole number. An
    empty table gives an empty result; columns other than the two named are not looked at.
    """
    out = _grouped(df, text, doc_id, percent, shingle, Scratch(df.sparkSession, "lines"))
    key = F.concat(*(F.lpad(F.lower(F.hex(k)), 16, "0") for k in ("k1", "k2")))
    return out.select("doc_id", "line_no", key.alias("line_key"), "first_doc_id", "first_line_no", "kept")


def dedup_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with only the kept lines in its texts; all rows stay, those that lose every line with an empty text.

    Blank lines stay between kept lines; a text that loses nothing is unchanged. A column
    n_chars, if there, is counted anew. Null texts stay null. All columns pass through, whatever their names.
    """
    groups = _grouped(df, text, doc_id, percent, shingle, Scratch(df.sparkSession, "lines"))
    r1, r2, lost = fresh(df, "r1_", "r2_", "lost_")
    # One document's lines at the most.
    dropped = groups.filter("NOT kept").groupBy("r1", "r2").agg(F.sort_array(F.collect_set("line_no")).alias(lost)).toDF(r1, r2, lost)
    own = _row_key(text, doc_id)
    out = df.join(dropped, (own[0] == F.col(r1)) & (own[1] == F.col(r2)), "left")
    parts = F.split(F.col(text), "\n")
    # What lies between lost lines, run by run.
    before = F.concat(F.array(F.lit(-1)), F.col(lost))
    after = F.concat(F.col(lost), F.array(F.size(parts)))
    left = F.array_join(F.flatten(F.zip_with(before, after, lambda a, b: F.slice(parts, a + 2, b - a - 1))), "\n")
    left = F.when(_trimmed(left) == "", F.lit("")).otherwise(left)
    out = out.withColumn(text, F.when(F.col(lost).isNull() | F.col(text).isNull(), F.col(text)).otherwise(left))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length(text), F.lit(0)).cast(df.schema["n_chars"].dataType))
    return out.select(*df.columns)


def op1_fuzzy_lines(spark, sf_dir: str) -> DataFrame:
    """Every line of all documents: where its component's first line is, and whether it stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_groups(docs, shingle=NEAR_SHINGLE).select("doc_id", "line_no", "first_doc_id", "first_line_no", "kept")
