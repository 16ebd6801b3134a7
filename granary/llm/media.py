"""AVI motion-JPEG columns: write, parse by index, decode intra frames, detect shots.

``encode`` stores bytes losslessly as baseline JPEG frames: each byte is the level of a flat
8 x 8 block, whose DC coefficient at a quantizer step of 8 is the level itself, so that any JPEG
decoder shows it exactly. 24 x 24 blocks make a frame. The Huffman table gives the
difference category s a code of 9 - s bits: with its s further bits and the one-bit end of block,
each block takes 10 bits, and whole frames are packed and unpacked as arrays. Other
baseline frames go through the general decoder.

Shots end where the difference of neighbouring frames' luma histograms exceeds an adaptive
threshold: the mean and ``DEVIATIONS`` standard deviations of the differences before it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE = 24
SAMPLES = SIDE * SIDE
FPS = 25
BINS = 16
WINDOW, DEVIATIONS, LEAST = 12, 3.0, 0.10


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0, 8] + [1] * 63))
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE * 8, SIDE * 8, 1, 1, 0x11, 0))
    + _segment(0xC4, bytes([0x00] + [1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))
    + _segment(0xC4, bytes([0x10, 1] + [0] * 15 + [0]))
    + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
)
_TAIL = b"\xff\xd9"


def _symbols() -> np.ndarray:
    """The 10 bits of each difference, by difference + 255."""
    out = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = (1 << (9 - s)) - 2  # 8 - s ones and a zero
        out[d + 255] = (code << s | (d if d > 0 else d + (1 << s) - 1)) << 1
    return out


_SYMBOL = _symbols()
_DIFFERENCE = np.full(1024, 32767, np.int16)
_DIFFERENCE[_SYMBOL] = np.arange(-255, 256)


def padded(data: bytes) -> bytes:
    """``data`` and bytes 255 up to a positive multiple of a frame's samples."""
    return data + b"\xff" * (-len(data) % SAMPLES if data else SAMPLES)


def jpegs(payload: bytes) -> list[bytes]:
    """A frame for each 576 bytes."""
    v = np.frombuffer(payload, np.uint8).reshape(-1, SAMPLES).astype(np.int16) - 128
    d = np.diff(v, axis=1, prepend=np.int16(0))
    s = _SYMBOL[d + 255].reshape(len(v), -1, 4).astype(np.uint64)
    quad = s[..., 0] << np.uint64(30) | s[..., 1] << np.uint64(20) | s[..., 2] << np.uint64(10) | s[..., 3]
    packed = np.ascontiguousarray(quad.astype(">u8")).view(np.uint8).reshape(len(v), -1, 8)[..., 3:]
    scan = packed.reshape(len(v), -1).tobytes()
    size = SAMPLES * 10 // 8
    return [_HEAD + scan[i : i + size].replace(b"\xff", b"\xff\x00") + _TAIL for i in range(0, len(scan), size)]


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def avi(frames: list[bytes], width: int = SIDE * 8, height: int = SIDE * 8, fps: int = FPS) -> bytes:
    """An AVI file of motion-JPEG frames with an idx1 index."""
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        movi.append(c := _chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
    body = b"AVI " + hdrl + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    if len(body) >= 2**32:
        raise ValueError("an AVI file holds under 4 GB")
    return _chunk(b"RIFF", body)


@dataclass
class Video:
    """fps and the byte ranges of the frames, in order."""

    fps: float
    frames: list[tuple[int, int]]


def parse_avi(data: bytes) -> Video:
    """Find the video's frames by the idx1 index, or, where there is none, by walking the movi list."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movi, index, walked = float(FPS), None, None, []

    def walk(at: int, end: int) -> None:
        nonlocal fps, movi, index
        while at + 8 <= end:
            kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            if kind == b"LIST":
                name = data[body : body + 4]
                if name == b"movi":
                    movi = body
                if name != b"movi" or not indexed:
                    walk(body + 4, min(end, body + size))
            elif kind == b"strh" and data[body : body + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", data, body + 20)
                fps = rate / scale if scale else fps
            elif kind == b"idx1":
                index = (body, size)
            elif kind[2:] in (b"dc", b"db"):
                walked.append((body, body + size))
            at = body + size + size % 2

    end = min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])
    indexed = _has_index(data, end)
    walk(12, end)
    if index is None or movi is None:
        return Video(fps, walked)
    entries = np.frombuffer(data, np.dtype([("kind", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]), index[1] // 16, index[0])
    entries = entries[np.array([k[2:] in (b"dc", b"db") for k in entries["kind"]], dtype=bool)]
    # Offsets count from the list's name or, in some files, from the file's start.
    base = movi if len(entries) and data[movi + int(entries["at"][0]) :][:4] == entries["kind"][0] else 0
    return Video(fps, [(base + int(a) + 8, base + int(a) + 8 + int(n)) for a, n in zip(entries["at"], entries["size"], strict=True)])


def _has_index(data: bytes, end: int) -> bool:
    """Whether one of the file's own chunks is an idx1 chunk; those bytes inside a frame are none."""
    at = 12
    while at + 8 <= end:
        if data[at : at + 4] == b"idx1":
            return True
        at += 8 + (size := struct.unpack_from("<I", data, at + 4)[0]) + size % 2
    return False


def read_flat(frames: list[bytes]) -> np.ndarray | None:
    """(frames, 576) block levels of frames as ``jpegs`` writes them; None if any is of another kind."""
    scans = []
    for f in frames:
        if not f.startswith(_HEAD) or not f.endswith(_TAIL):
            return None
        scan = f[len(_HEAD) : -len(_TAIL)].replace(b"\xff\x00", b"\xff")
        if len(scan) != SAMPLES * 10 // 8:
            return None
        scans.append(scan)
    five = np.frombuffer(b"".join(scans), np.uint8).reshape(-1, 5).astype(np.uint64)
    quad = five[:, 0] << np.uint64(32) | five[:, 1] << np.uint64(24) | five[:, 2] << np.uint64(16) | five[:, 3] << np.uint64(8) | five[:, 4]
    s = np.stack([quad >> np.uint64(30), quad >> np.uint64(20), quad >> np.uint64(10), quad], axis=1) & np.uint64(1023)
    d = _DIFFERENCE[s].reshape(len(frames), SAMPLES)
    v = np.cumsum(d, axis=1, dtype=np.int64) + 128
    return v.astype(np.uint8) if (v >= 0).all() and (v <= 255).all() else None


def _zigzag() -> np.ndarray:
    """Row-major place of each zigzag position: along diagonals, up on even ones."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    order = sorted(cells, key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else -x[0]))
    return np.array([8 * r + c for r, c in order])


_ZIGZAG = _zigzag()
_C = np.array([[(0.5**0.5 if u == 0 else 1.0) / 2 * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])


def decode_luma(frame: bytes) -> np.ndarray:
    """The first component's samples of a baseline JPEG frame with its own tables, at that component's resolution."""
    quant: dict[int, np.ndarray] = {}
    huff: dict[int, dict[tuple[int, int], int]] = {}
    shape, parts, restart, at = (0, 0), [], 0, 2
    while at + 4 <= len(frame):
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body, at = frame[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide, n = body[0] >> 4, 129 if body[0] >> 4 else 65
                quant[body[0] & 15] = np.frombuffer(body[1:n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[n:]
        elif marker == 0xC4:
            while body:
                counts, code, k, table = body[1:17], 0, 17, {}
                for length, n in enumerate(counts, 1):
                    for _ in range(n):
                        table[length, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                huff[body[0]] = table
                body = body[k:]
        elif marker == 0xC0 or marker == 0xC1:
            shape = struct.unpack_from(">HH", body, 1)
            parts = [[body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]] for i in range(6, 6 + 3 * body[5], 3)]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
    for p in parts:
        p += [huff[tables[p[0]] >> 4], huff[0x10 | tables[p[0]] & 15]]
    hmax, vmax = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        parts[0][1] = parts[0][2] = hmax = vmax = 1
    across, down = -(-shape[1] // (8 * hmax)), -(-shape[0] // (8 * vmax))
    own = parts[0]
    blocks = np.zeros((down * own[2], across * own[1], 64), np.int64)
    scan = frame[at:]
    end = next((i for i in range(len(scan) - 1) if scan[i] == 0xFF and scan[i + 1] != 0 and not 0xD0 <= scan[i + 1] <= 0xD7), len(scan))
    runs, start = [], 0
    for i in range(end - 1):
        if scan[i] == 0xFF and 0xD0 <= scan[i + 1] <= 0xD7:
            runs.append(scan[start:i])
            start = i + 2
    runs.append(scan[start:end])
    mcu = 0
    for run in runs:
        bits = iter(np.unpackbits(np.frombuffer(run.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist())

        def symbol(table, bits=bits):
            code = length = 0
            while True:
                code, length = code << 1 | next(bits), length + 1
                if (length, code) in table:
                    return table[length, code]

        def extra(n, bits=bits):
            v = 0
            for _ in range(n):
                v = v << 1 | next(bits)
            return v if not n or v >> (n - 1) else v - (1 << n) + 1

        last = [0] * len(parts)
        for _ in range(restart or across * down):
            if mcu >= across * down:
                break
            for i, (_, h, v, _, dc, ac) in enumerate(parts):
                for y in range(v):
                    for x in range(h):
                        last[i] += extra(symbol(dc))
                        block, k = {0: last[i]}, 1
                        while k < 64:
                            rs = symbol(ac)
                            if rs & 15:
                                k += rs >> 4
                                block[k] = extra(rs & 15)
                                k += 1
                            elif rs == 0xF0:
                                k += 16
                            else:
                                break
                        if i == 0:
                            cell = blocks[mcu // across * v + y, mcu % across * h + x]
                            cell[list(block)] = list(block.values())
            mcu += 1
    coefficients = np.zeros_like(blocks, dtype=np.float64)
    coefficients[..., _ZIGZAG] = blocks * quant[own[3]]
    pixels = _C @ coefficients.reshape(*blocks.shape[:2], 8, 8) @ _C.T
    plane = np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(blocks.shape[0] * 8, -1)
    return plane[: -(-shape[0] * own[2] // vmax), : -(-shape[1] * own[1] // hmax)]


def histograms(planes: np.ndarray | list[np.ndarray]) -> np.ndarray:
    """Each frame's shares of luma in 16 bins."""
    if isinstance(planes, np.ndarray):
        n = len(planes)
        at = (planes >> 4).astype(np.int64) + BINS * np.arange(n)[:, None]
        return np.bincount(at.ravel(), minlength=n * BINS).reshape(n, BINS) / planes.shape[1]
    return np.array([np.bincount((p >> 4).ravel(), minlength=BINS) / p.size for p in planes]).reshape(-1, BINS)


def cuts(hist: np.ndarray) -> list[int]:
    """Frames that begin a shot, after the first. The threshold follows the up to 12 differences before."""
    if len(hist) < 2:
        return []
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    s, q = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    i = np.arange(len(d))
    j = np.maximum(0, i - WINDOW)
    n = np.maximum(1, i - j)
    mean = (s[i] - s[j]) / n
    sd = np.sqrt(np.maximum(0, (q[i] - q[j]) / n - mean * mean))
    return (np.flatnonzero(d > np.maximum(LEAST, mean + DEVIATIONS * sd)) + 1).tolist()


def read_frames(data: bytes) -> tuple[Video, np.ndarray | list[np.ndarray]]:
    """A file's frames, decoded: block levels (frames, 576) for ``jpegs`` frames, else luma planes."""
    video = parse_avi(data)
    frames = [data[a:b] for a, b in video.frames]
    flat = read_flat(frames) if frames else np.zeros((0, SAMPLES), np.uint8)
    return video, flat if flat is not None else [decode_luma(f) for f in frames]


def encode(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``df`` with a binary column ``media``: each text's UTF-8 bytes, padded, as an AVI file. A null or empty text is one frame of 255.

    A column of ``df`` with that name is replaced; all others pass through.
    """
    df = df.drop(*(c for c in df.columns if c.lower() == media.lower()))
    at = df.columns.index(text)
    names = [*df.columns, media]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                files = [avi(jpegs(padded((t.as_py() or "").encode()))) for t in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(files, pa.binary())], names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(media, T.BinaryType())]))


def clips(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """A row for each shot of each file: key, clip (from 0), first_frame, last_frame, start_s, end_s. Null files and files without frames give no rows."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, clip int, first_frame int, last_frame int, start_s double, end_s double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for i, m in enumerate(batch.column(1)):
                if m.as_py() is None:
                    continue
                video, planes = read_frames(m.as_py())
                starts = [0, *cuts(histograms(planes))] if len(planes) else []
                for c, (a, b) in enumerate(zip(starts, [*starts[1:], len(planes)], strict=False)):
                    row.append(i)
                    out.append((c, a, b - 1, a / video.fps, b / video.fps))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *columns], [key, "clip", "first_frame", "last_frame", "start_s", "end_s"])

    return df.select(F.col(key), F.col(media)).mapInArrow(run, schema)


def digests(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Round trip of every text: stored as a file, parsed and decoded from those bytes. See ``op7_avi_mjpeg`` for the columns."""
    kind = df.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1):
                data = (t.as_py() or "").encode()
                stored = avi(jpegs(padded(data)))
                video, levels = read_frames(stored)
                payload = levels.tobytes()
                at = cuts(histograms(levels))
                feature = f"frames={len(levels)};shots={len(at) + 1};cuts={','.join(map(str, at))};seconds={len(levels) / video.fps:.2f}"
                out.append((len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return df.select(F.col(doc_id), F.col(text)).mapInArrow(run, schema)


def op7_avi_mjpeg(spark, sf_dir: str) -> DataFrame:
    """Every document as an AVI motion-JPEG file, read back: sizes, digests, and its shots as the feature."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
