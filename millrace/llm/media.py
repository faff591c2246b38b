"""ISO media containers as columns: writing and reading nested boxes without decoding what the samples hold.

Samples are found through the sample tables of `moov` and through the runs of movie fragments (`moof`), which may follow one another in one file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, blob, named

UNIT, CHUNK, TIMESCALE = 64, 64, 25
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf", b"udta"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
INFO = "brand string, tracks array<struct<track_id: bigint, handler: string, codec: string, timescale: bigint, duration: bigint, seconds: double, presented: double, n_samples: bigint, sample_bytes: bigint, n_keyframes: bigint, keyframes: array<struct<first: bigint, end: bigint>>>>, error string"


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux(payload: bytes) -> bytes:
    """A file with one track of 8 x 8 pictures of 8-bit grey samples; each chunk of 64 pictures begins with a keyframe. payload: a positive multiple of 64 bytes."""
    n = len(payload) // UNIT
    if n < 1 or n * UNIT != len(payload):
        raise ValueError("a positive multiple of 64 bytes is needed")
    runs = (n + CHUNK - 1) // CHUNK
    whole, rest = divmod(n, CHUNK)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    wide = 16 + len(payload) >= 1 << 32
    start = len(ftyp) + (16 if wide else 8)
    spread = ([(1, CHUNK)] if whole else []) + ([(whole + 1, rest)] if rest else [])
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, n, 1)),
        full(b"stss", struct.pack(">I", runs), (np.arange(runs) * CHUNK + 1).astype(">u4").tobytes()),
        full(b"stsc", struct.pack(">I", len(spread)), *(struct.pack(">III", a, b, 1) for a, b in spread)),
        full(b"stsz", struct.pack(">II", UNIT, n)),
        full(b"co64" if wide else b"stco", struct.pack(">I", runs), (start + np.arange(runs) * CHUNK * UNIT).astype(">u8" if wide else ">u4").tobytes()),
    )
    minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"), minf)
    tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), MATRIX, struct.pack(">II", 8 << 16, 8 << 16), flags=7)
    mvhd = full(b"mvhd", struct.pack(">IIIIIHH", 0, 0, TIMESCALE, n, 0x10000, 0x100, 0), bytes(8), MATRIX, bytes(24), struct.pack(">I", 2))
    return b"".join((ftyp, box(b"mdat", payload), box(b"moov", mvhd, box(b"trak", tkhd, mdia))))


def walk(data: bytes):
    """(depth, kind, first byte of the box, first and end byte of its body) of every box, outer ones first, however deep. ValueError: a box leaves the one around it."""
    open_ = [(0, len(data))]
    while open_:
        low, high = open_.pop()
        if low >= high:
            continue
        if high - low < 8:
            if any(data[low:high]):
                raise ValueError(f"bytes without a box at {low}")
            continue
        size, kind = struct.unpack_from(">I4s", data, low)
        head = 8
        if size == 1:
            if high - low < 16:
                raise ValueError(f"cut box at {low}")
            size, head = struct.unpack_from(">Q", data, low + 8)[0], 16
        elif size == 0:
            size = high - low
        if kind == b"uuid":
            head += 16
        if size < head or low + size > high:
            raise ValueError(f"box at {low} has a wrong size")
        yield len(open_), kind, low, low + head, low + size
        open_.append((low + size, high))
        if kind in CONTAINERS:
            open_.append((low + head, low + size))


def _numbers(data: bytes, at: int, end: int, count: int, dtype: str, width: int = 1) -> np.ndarray:
    n = np.dtype(dtype).itemsize * width
    if count * n > end - at:
        raise ValueError("a table is longer than its box")
    out = np.frombuffer(data, dtype, count * width, at).astype(np.int64)
    return out.reshape(count, width) if width > 1 else out


def _table(data: bytes, span: tuple[int, int], dtype: str, width: int = 1) -> np.ndarray:
    at, end = span
    if end - at < 8:
        raise ValueError("a table is cut")
    return _numbers(data, at + 8, end, struct.unpack_from(">I", data, at + 4)[0], dtype, width)


def samples(data: bytes, tables: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and sizes of a track's samples, from its sample tables."""
    if b"stsz" in tables:
        at, end = tables[b"stsz"]
        if end - at < 12:
            raise ValueError("stsz is cut")
        each, count = struct.unpack_from(">II", data, at + 4)
        if each and count * each > len(data):
            raise ValueError("stsz has more samples than the file")
        sizes = np.full(count, each, np.int64) if each else _numbers(data, at + 12, end, count, ">u4")
    elif b"stz2" in tables:
        at, end = tables[b"stz2"]
        field, count = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
        if field == 4:
            packed = _numbers(data, at + 12, end, (count + 1) // 2, "u1")
            sizes = np.stack([packed >> 4, packed & 15], 1).ravel()[:count]
        else:
            sizes = _numbers(data, at + 12, end, count, {8: "u1", 16: ">u2"}[field])
    else:
        raise ValueError("no sample sizes")
    if not len(sizes):
        return sizes, sizes
    chunks = _table(data, tables[b"co64"], ">u8") if b"co64" in tables else _table(data, tables[b"stco"], ">u4")
    spread = _table(data, tables[b"stsc"], ">u4", 3)
    if not len(spread) or spread[0, 0] != 1 or (np.diff(spread[:, 0]) <= 0).any() or (spread[:, 1] <= 0).any():
        raise ValueError("wrong stsc")
    per = spread[np.searchsorted(spread[:, 0], np.arange(1, len(chunks) + 1), "right") - 1, 1]
    if per.sum() > len(data) or per.sum() != len(sizes):
        raise ValueError("stsc and stsz differ")
    chunk = np.repeat(np.arange(len(chunks)), per)
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per) - per
    offsets = chunks[chunk] + before - before[first[chunk]]
    if (offsets < 0).any() or (offsets + sizes > len(data)).any():
        raise ValueError("samples lie outside the file")
    return offsets, sizes


def merged(offsets: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges, first and end, of samples in their order; touching ones become one."""
    if not len(offsets):
        return []
    new = np.flatnonzero(np.concatenate([[True], offsets[1:] != (offsets + sizes)[:-1]]))
    last = np.concatenate([new[1:], [len(offsets)]]) - 1
    return list(zip(offsets[new].tolist(), (offsets + sizes)[last].tolist(), strict=True))


class Movie:
    """The boxes that describe samples: spans of bodies by kind, for each track, and each fragment's start and tracks; defaults of fragments by track id."""

    def __init__(self, data: bytes):
        self.head: dict[bytes, tuple[int, int]] = {}
        self.tracks: list[dict[bytes, tuple[int, int]]] = []
        self.fragments: list[tuple[int, list[tuple[tuple[int, int], list[tuple[int, int]]]]]] = []
        self.defaults: dict[int, tuple[int, int, int]] = {}
        within: list[bytes] = []
        for depth, kind, start, a, b in walk(data):
            del within[depth - 1 :]
            within.append(kind)
            if kind == b"trak":
                self.tracks.append({})
            elif kind == b"moof":
                self.fragments.append((start, []))
            elif kind == b"trex":
                track, _, *found = struct.unpack_from(">5I", data, a + 4)
                self.defaults[track] = tuple(found)
            elif kind == b"tfhd" and b"traf" in within and self.fragments:
                self.fragments[-1][1].append(((a, b), []))
            elif kind == b"trun" and b"traf" in within:
                if not self.fragments or not self.fragments[-1][1]:
                    raise ValueError("trun without tfhd")
                self.fragments[-1][1][-1][1].append((a, b))
            elif kind not in CONTAINERS and self.tracks and b"trak" in within:
                self.tracks[-1].setdefault(kind, (a, b))
            elif kind == b"mvhd":
                self.head = {kind: (a, b)}


def number_of(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> int:
    at = boxes[b"tkhd"][0]
    return struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]


def runs(data: bytes, movie: Movie) -> dict[int, list[np.ndarray]]:
    """By track id: rows (offset, size, duration, whether it is a sync sample) of the samples of all fragments, one array for each run."""
    out: dict[int, list[np.ndarray]] = {}
    for start, parts in movie.fragments:
        reached = start
        for nth, ((a, _), spans) in enumerate(parts):
            flags, track = struct.unpack_from(">II", data, a)
            flags, at = flags & 0xFFFFFF, a + 8
            given = list(movie.defaults.get(track, (0, 0, 0)))
            base = start if nth == 0 or flags & 0x20000 else reached
            if flags & 1:
                base, at = struct.unpack_from(">Q", data, at)[0], at + 8
            at += 4 * (flags >> 1 & 1)
            for i, bit in enumerate((0x8, 0x10, 0x20)):
                if flags & bit:
                    given[i], at = struct.unpack_from(">I", data, at)[0], at + 4
            reached = base
            for low, high in spans:
                flags, count = struct.unpack_from(">II", data, low)
                flags, at = flags & 0xFFFFFF, low + 8
                if flags & 1:
                    reached, at = base + struct.unpack_from(">i", data, at)[0], at + 4
                first = None
                if flags & 4:
                    first, at = struct.unpack_from(">I", data, at)[0], at + 4
                bits = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
                if not bits and count * max(given[1], 1) > len(data):
                    raise ValueError("a run has more samples than the file")
                told = _numbers(data, at, high, count, ">u4", len(bits)).reshape(count, len(bits)) if bits else np.zeros((count, 0), np.int64)
                length, size, kind = (told[:, bits.index(bit)] if bit in bits else np.full(count, value, np.int64) for bit, value in zip((0x100, 0x200, 0x400), given, strict=True))
                if first is not None and count:
                    kind = np.append(first, kind[1:])
                rows = np.stack([reached + np.cumsum(size) - size, size, length, (kind >> 16 & 1) == 0], 1)
                if (rows[:, 0] < 0).any() or (rows[:, 0] + size > len(data)).any():
                    raise ValueError("samples lie outside the file")
                out.setdefault(track, []).append(rows)
                reached += int(size.sum())
    return out


def all_samples(data: bytes, boxes: dict[bytes, tuple[int, int]], more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, sizes and the numbers of sync samples of a track, those of fragments last."""
    offsets, sizes = samples(data, boxes)
    keys = np.arange(len(sizes)) if b"stss" not in boxes else _table(data, boxes[b"stss"], ">u4") - 1
    if len(keys) and (keys.min() < 0 or keys.max() >= len(sizes)):
        raise ValueError("stss names a missing sample")
    rows = np.concatenate([np.zeros((0, 4), np.int64), *more])
    keys = np.concatenate([keys, len(sizes) + np.flatnonzero(rows[:, 3])])
    return np.concatenate([offsets, rows[:, 0]]), np.concatenate([sizes, rows[:, 1]]), keys


def presented(data: bytes, boxes: dict[bytes, tuple[int, int]], head: dict[bytes, tuple[int, int]]) -> float | None:
    """Seconds that a track's edit list presents, None if it has none or the movie no time scale."""
    if b"elst" not in boxes or b"mvhd" not in head:
        return None
    at = head[b"mvhd"][0]
    scale = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]
    edits = _table(data, boxes[b"elst"], ">u4", 5 if data[boxes[b"elst"][0]] == 1 else 3)
    total = edits[:, 0] * (1 << 32) + edits[:, 1] if edits.shape[1] == 5 else edits[:, 0]
    return float(total.sum()) / scale if scale else None


def describe(data: bytes | None) -> dict:
    """brand, tracks and error; keyframes are byte ranges of sync samples, also of fragments. Null or damaged data, and files without a track: no tracks and the reason.

    A duration that the header leaves open (0 before fragments, all bits set) is that of the fragments' samples, null if there are none. presented:
    the seconds of the edit list, null without one.
    """
    out: dict = {"brand": None, "tracks": [], "error": None}
    if not data:
        return out | {"error": "empty"}
    try:
        if data[4:8] == b"ftyp" and len(data) >= 12:
            out["brand"] = data[8:12].decode("latin-1")
        movie = Movie(data)
        more = runs(data, movie)
        numbers = [number_of(data, boxes) for boxes in movie.tracks]
        if missing := set(more) - set(numbers):
            raise ValueError(f"fragments of tracks {sorted(missing)} that moov does not have")
        if not numbers:
            raise ValueError("no tracks")
        for number, boxes in zip(numbers, movie.tracks, strict=True):
            a, _ = boxes[b"mdhd"]
            wide = data[a] == 1
            scale, duration = struct.unpack_from(">IQ", data, a + 20) if wide else struct.unpack_from(">II", data, a + 12)
            rows = more.get(number, [])
            if duration == (1 << (64 if wide else 32)) - 1 or (rows and not duration):
                duration = sum(int(r[:, 2].sum()) for r in rows) if rows else None
            handler = data[boxes[b"hdlr"][0] + 8 : boxes[b"hdlr"][0] + 12].decode("latin-1")
            offsets, sizes, keys = all_samples(data, boxes, rows)
            out["tracks"].append(
                {
                    "track_id": number, "handler": handler, "codec": data[boxes[b"stsd"][0] + 12 : boxes[b"stsd"][0] + 16].decode("latin-1"), "timescale": scale, "duration": duration,
                    "seconds": duration / scale if scale and duration is not None else None, "presented": presented(data, boxes, movie.head), "n_samples": len(sizes), "sample_bytes": int(sizes.sum()),
                    "n_keyframes": len(keys), "keyframes": [{"first": x, "end": y} for x, y in merged(offsets[keys], sizes[keys])],
                }
            )
    except (ValueError, KeyError, IndexError, OverflowError, struct.error) as e:
        return out | {"tracks": [], "error": f"{type(e).__name__}: {e}"}
    return out


def demux(data: bytes, track: int = 0) -> bytes:
    """The bytes of all samples of a track, in order."""
    movie = Movie(data)
    boxes = movie.tracks[track]
    offsets, sizes, _ = all_samples(data, boxes, runs(data, movie).get(number_of(data, boxes), []))
    return b"".join(data[a:b] for a, b in merged(offsets, sizes))


def described(df: DataFrame, column: str = "media", id_col: str = "doc_id") -> DataFrame:
    """(id_col, brand, tracks, error) of a binary column of ISO media files. Null and damaged files give error and no tracks, never a failure."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        found = [describe(x) for x in batch["media"]]
        return {"id": batch["id"]} | {k: [x[k] for x in found] for k in ("brand", "tracks", "error")}

    return arrow_map(df.select(F.col(named(id_col)).alias("id"), F.col(named(column)).alias("media")), f"id {dict(df.dtypes)[id_col]}, {INFO}", run).withColumnRenamed("id", id_col)


def padded(text: bytes | None) -> bytes:
    text = text or b""
    return text + bytes(-len(text) % UNIT if text else UNIT)


def stored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, media): each text, padded with zero bytes, as a file of mux(). Null is empty."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        return {"id": batch["id"], "media": [mux(padded(x)) for x in batch["text"]]}

    return arrow_map(df.select(F.col(named(id_col)).alias("id"), blob(text_col).alias("text")), f"id {dict(df.dtypes)[id_col]}, media binary", run).withColumnRenamed("id", id_col)


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of df: sizes and hashes of the stored file and of what is read back from it, codec, seconds and keyframe ranges. Null text is empty; repeated rows give a row each; an empty table gives an empty result; other columns are ignored."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "seconds", "keyframes")}
        for text in batch["text"]:
            media = mux(padded(text))
            info, back = describe(media)["tracks"][0], demux(media)
            ranges = ",".join(f"{r['first']}-{r['end']}" for r in info["keyframes"])
            row = (len(text or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), f"{info['codec'].strip()};{info['duration']}/{info['timescale']};{info['n_samples']};{ranges}", info["codec"], info["seconds"], info["keyframes"])
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return {"id": batch["id"]} | out

    schema = f"id {dict(df.dtypes)[id_col]}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, codec string, seconds double, keyframes array<struct<first: bigint, end: bigint>>"
    return arrow_map(df.select(F.col(named(id_col)).alias("id"), blob(text_col).alias("text")), schema, run).withColumnRenamed("id", id_col)


def op1_media(spark, sf_dir: str) -> DataFrame:
    return media_features(spark.read.parquet(f"{sf_dir}/documents.parquet"))
