"""Sequence packing: shortest-pack-first over the histogram of lengths.

Documents are tokenized and cut into pieces of at most ``limit`` ids. The driver sees only the
histogram of piece lengths (at most ``limit`` counts, whatever the input). It places lengths
longest first; each goes to the open pack with the least ids in it that still has room for it,
all packs of one make at a time, so the work is in patterns and counts, not pieces. Pieces then find their pack by their rank
among pieces of equal length, in a join with the pattern table.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import Scratch, fresh, literal_table, released

#: A worker remembers the ids of so many words, and of as many that it met before those.
WORDS_KEPT = 200_000
#: Documents whose texts and ids a worker holds at a time.
ROWS = 256
_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz")
_STOPS = frozenset(b".,")
#: Lower-case Latin-1 letters: one run for the tokenizer, changed by none of its normalizers.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: First bytes of characters from U+0300 on; none below composes with a letter.
_FAR = re.compile(b"[\xcc-\xff]")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else the next from 256 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    moved = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(moved)}


_LETTER = _byte_letters()


class WordCache:
    """Ids of words between ASCII white space, as little-endian bytes of unsigned 32-bit numbers.

    No step of the tokenizer looks across white space, nor, within a word, from a letter to a
    full stop or comma that ends the word. So a text's ids are those of such parts, each tokenized
    once and remembered. A-Z are lowered first, but not in words that hold an added token's text,
    which is taken as written, or characters from U+0300 on: marks may compose with the lower-case
    letter only, and the tokenizer composes before it lowers. Plain words go to the merges
    directly, past normalizers and patterns that can't change or cut them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.now: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        """Afterwards ``now`` holds all of ``words``."""
        if len(self.now) > WORDS_KEPT:
            self.before, self.now = self.now, {}
        now, before = self.now, self.before
        new, ended = [], []
        for w in words.difference(now):
            got = before.get(w)
            if got is not None:
                now[w] = got
            elif len(w) > 1 and w[-1] in _STOPS and w[-2] in _LETTERS:
                ended.append(w)
            else:
                new.append(w)
        cores = {x for w in ended for x in (w[:-1], w[-1:])}.difference(now, new)
        new.extend(cores)
        odd, merges = [], self.tokenizer.model.tokenize
        for w in new:
            text = w.decode("utf-8", "replace")
            if _PLAIN.fullmatch(text):
                letters = text if text.isascii() else "".join(map(_LETTER.__getitem__, w))
                now[w] = np.array([t.id for t in merges(letters)], dtype="<u4").tobytes()
            else:
                odd.append((w, text))
        for w, e in zip(odd, self.tokenizer.encode_batch_fast([t for _, t in odd], add_special_tokens=False), strict=True):
            now[w[0]] = np.array(e.ids, dtype="<u4").tobytes()
        for w in ended:
            now[w] = now[w[:-1]] + now[w[-1:]]

    def words(self, text: str) -> list[bytes]:
        raw = text.encode("utf-8", "replace")
        low = raw.lower()
        added = [a for a in self.added if a in low]
        if not added and (raw.isascii() or not _FAR.search(raw)):
            return low.split()
        return [w if _FAR.search(w) or any(a in w.lower() for a in added) else w.lower() for w in raw.split()]

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text. Words are learnt for a few texts at a time."""
        for at in range(0, len(texts), 64):
            words = [self.words(t) for t in texts[at : at + 64]]
            self.learn(set().union(*words))
            get = self.now.__getitem__
            yield from (b"".join(map(get, w)) for w in words)


_caches: dict[str, WordCache] = {}


def cut_pieces(df: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", limit: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, and ids where asked for.

    A document's ids end with ``end_id``; a null or empty text is that id alone. Texts of any
    length are cut into as many pieces as they need; repeated rows are each a document; an empty table
    gives no pieces. Other columns are not looked at and not kept.
    """
    schema = f"doc_id {df.schema[doc_id].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    schema += ", ids array<int>" if with_ids else ""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _caches.get(tokenizer)
        if words is None:
            words = _caches[tokenizer] = WordCache(tokenizer)
        for part in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            rows, start, length, crc, total, ids = [], [], [], [], [], []
            texts = [t or "" for t in part.column(1).to_pylist()]
            for i, all_ids in enumerate(words.ids(texts)):
                all_ids += end
                for at in range(0, len(all_ids), 4 * limit):
                    piece = all_ids[at : at + 4 * limit]
                    rows.append(i)
                    start.append(at // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(all_ids) // 4)
                    if with_ids:
                        ids.append(np.frombuffer(piece, dtype="<i4"))
            columns = [part.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.select(F.col(doc_id), F.col(text)).mapInArrow(released(cut), schema)


def pack_histogram(histogram: dict[int, int], limit: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(number of packs, ((length, times), ...)) for the lengths and counts of ``histogram``.

    Lengths go longest first. Of the open packs that a length fits, the emptiest are
    filled first; packs of one make are kept together as (room, pattern) with a count.
    """
    open_: list[dict[tuple, int]] = [{} for _ in range(limit + 1)]  # by room left
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        room = limit
        while left:
            while room >= length and not open_[room]:
                room -= 1
            if room < length:  # no pack has room: open new ones, each filled with as many as fit
                each = limit // length
                full, rest = divmod(left, each)
                if full:
                    _put(open_, limit - each * length, ((length, each),), full)
                if rest:
                    _put(open_, limit - rest * length, ((length, rest),), 1)
                break
            pattern, packs = open_[room].popitem()
            each = min(room // length, max(1, left // packs))
            used = min(packs, left // each)
            if used < packs:
                open_[room][pattern] = packs - used
            _put(open_, room - each * length, (*pattern, (length, each)), used)
            left -= used * each
    return [(n, p) for packs in open_ for p, n in packs.items()]


def _put(open_: list[dict[tuple, int]], room: int, pattern: tuple, n: int) -> None:
    open_[room][pattern] = open_[room].get(pattern, 0) + n


def pack(pieces: DataFrame, limit: int = 2048, length: str = "length", order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """``pieces`` with sequence_id (long, gapless from 0) and offset (long): where each lies.

    Equal lengths and repeated rows are interchangeable and told apart by their rank; lengths
    are 1 to ``limit``. An empty table stays empty. Columns named sequence_id or offset are replaced, all others pass through.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    part, rank, l_, p_, base, size_, from_, to_, times_, sequence_, offset_ = fresh(pieces, "part_", "rank_", "l_", "p_", "base_", "size_", "from_", "to_", "times_", "sequence_", "offset_")
    scratch = Scratch(spark, "pack")
    pieces = scratch.write(pieces.withColumn(part, F.spark_partition_id()), "pieces")
    # Many pieces share a length where many documents are equal or long: ranks are made of parts.
    counts = pieces.groupBy(length, part).agg(F.count("*").alias("n_"))
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy(length).agg(F.sum("n_")).collect()}
    rows, sequence = [], 0
    begun: dict[int, int] = dict.fromkeys(histogram, 0)
    for n, pattern in sorted(pack_histogram(histogram, limit), key=lambda x: x[1], reverse=True):
        offset = 0
        for size, times in pattern:
            rows.append((size, begun[size], begun[size] + n * times, times, sequence, offset))
            begun[size] += n * times
            offset += size * times
        sequence += n
    table = literal_table(spark, rows, "size_ int, from_ bigint, to_ bigint, times_ bigint, sequence_ bigint, offset_ bigint").toDF(size_, from_, to_, times_, sequence_, offset_)
    up_to = Window.partitionBy(length).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col(length).alias(l_), F.col(part).alias(p_), F.coalesce(F.sum("n_").over(up_to), F.lit(0)).alias(base))
    ranked = pieces.withColumn(rank, F.row_number().over(Window.partitionBy(length, part).orderBy(*order)) - 1)
    ranked = ranked.join(bases, (F.col(length) == F.col(l_)) & (F.col(part) == F.col(p_))).withColumn(rank, F.col(rank) + F.col(base))
    nth = F.col(rank) - F.col(from_)
    # The pattern table is bounded by the limit, not by the input.
    out = ranked.join(F.broadcast(table), (F.col(length) == F.col(size_)) & (F.col(rank) >= F.col(from_)) & (F.col(rank) < F.col(to_)))
    within = F.pmod(nth, F.col(times_))
    sequence_id = F.col(sequence_) + ((nth - within) / F.col(times_)).cast("long")
    offset = (F.col(offset_) + within * F.col(length)).cast("long")
    return out.withColumns({"sequence_id": sequence_id, "offset": offset}).select(*(c for c in pieces.columns if c != part), "sequence_id", "offset")


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_spf_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(cut_pieces(docs, public_tokenizer(), with_ids=False))
