"""Matroska media columns: a writer for 8-bit PCM and a parser that yields packet tables.

The parser walks variable-length EBML elements, clusters (of known and unknown size), simple blocks
and block groups, all four lacings, and cues. Each document is handled alone, so nothing is shuffled.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Matroska element ids.
EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1
CLUSTER, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SCALE, DURATION, TIMESTAMP, NUMBER, UID, KIND, LACING, CODEC = 0x2AD7B1, 0x4489, 0xE7, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
RATE, CHANNELS, DEPTH, MUXER, WRITER, DOC_TYPE = 0xB5, 0x9F, 0x6264, 0x4D80, 0x5741, 0x4282
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

FRAME, SAMPLE_RATE = 192, 8000
FRAME_MS = FRAME * 1000 // SAMPLE_RATE
FRAMES_IN_BLOCK, BLOCKS_IN_CLUSTER = 8, 64
_ROWS = 256


def _id(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def _size(n: int) -> bytes:
    width = max(1, -(-(n + 1).bit_length() // 7))  # all ones means unknown, so it is left free
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(id_: int, body: bytes) -> bytes:
    return _id(id_) + _size(len(body)) + body


def _uint(id_: int, n: int) -> bytes:
    return _element(id_, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _lace(frames: list[bytes], lacing: int) -> bytes:
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING and len(sizes) > 1:
        head += _size(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
            d, width = b - a, 1
            while not -(1 << 7 * width - 1) < d < 1 << 7 * width - 1:
                width += 1
            head += (d + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    return head + b"".join(frames)


def write_pcm(samples: bytes, lacing: int = FIXED) -> bytes:
    """A Matroska file with one mono 8-bit PCM track; the same samples give the same bytes."""
    frames = [samples[i : i + FRAME] for i in range(0, len(samples), FRAME)]
    per_block = 1 if lacing == NO_LACING else FRAMES_IN_BLOCK
    info = _element(INFO, _uint(SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", len(samples) * 1000 / SAMPLE_RATE)) + _element(MUXER, b"pagequarry") + _element(WRITER, b"pagequarry"))
    audio = _element(AUDIO, _element(RATE, struct.pack(">d", float(SAMPLE_RATE))) + _uint(CHANNELS, 1) + _uint(DEPTH, 8))
    tracks = _element(TRACKS, _element(TRACK, _uint(NUMBER, 1) + _uint(UID, 1) + _uint(KIND, 2) + _uint(LACING, int(lacing != NO_LACING)) + _element(CODEC, b"A_PCM/INT/LIT") + audio))
    body, cues = [info, tracks], []
    at = len(info) + len(tracks)
    step = per_block * BLOCKS_IN_CLUSTER
    for c in range(0, len(frames), step):
        blocks = [_uint(TIMESTAMP, c * FRAME_MS)]
        for f in range(c, min(c + step, len(frames)), per_block):
            head = b"\x81" + struct.pack(">hB", (f - c) * FRAME_MS, 0x80 | lacing << 1)
            part = frames[f : f + per_block]
            blocks.append(_element(SIMPLE_BLOCK, head + (_lace(part, lacing) if lacing else part[0])))
        cluster = _element(CLUSTER, b"".join(blocks))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, c * FRAME_MS) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(_element(CUES, b"".join(cues)))
    head = _element(EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + _element(DOC_TYPE, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))
    return head + _element(SEGMENT, b"".join(body))


def _vint(data: bytes, at: int, keep_marker: bool) -> tuple[int, int, bool]:
    """The number at ``at``, where it ends, and whether all its bits are ones."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no element at byte {at}")
    width = 9 - data[at].bit_length()
    n = int.from_bytes(data[at : at + width], "big")
    if at + width > len(data):
        raise ValueError(f"cut off at byte {at}")
    plain = n & (1 << 7 * width) - 1
    return (n if keep_marker else plain), at + width, plain == (1 << 7 * width) - 1


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """``(id, start, end)`` of each child's body; a body of unknown size ends with its parent."""
    while at < end:
        id_, at, _ = _vint(data, at, True)
        n, at, unknown = _vint(data, at, False)
        stop = end if unknown else at + n
        if stop > end:
            raise ValueError(f"element {id_:x} ends beyond its parent")
        if unknown and id_ == CLUSTER:  # it ends where the next top-level element begins
            stop = at
            for child, _, child_end in elements(data, at, end):
                if child in (CLUSTER, CUES, TRACKS, INFO):
                    break
                stop = child_end
        yield id_, at, stop
        at = stop


def _frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative timestamp, flags and the byte ranges of a block's frames."""
    track, at, _ = _vint(data, at, False)
    when, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    if lacing == NO_LACING:
        return track, when, flags, [(at, end)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % n:
            raise ValueError("fixed lacing of unequal frames")
        sizes = [(end - at) // n] * (n - 1)
    elif lacing == XIPH:
        for _ in range(n - 1):
            total = 0
            while True:
                total, at = total + data[at], at + 1
                if data[at - 1] < 255:
                    break
            sizes.append(total)
    else:
        for i in range(n - 1):
            start = at
            v, at, _ = _vint(data, at, False)
            sizes.append(v if i == 0 else sizes[-1] + v - (1 << 7 * (at - start) - 1) + 1)
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    if at > end or any(b < a for a, b in out):
        raise ValueError("laced frames end beyond their block")
    return track, when, flags, [*out, (at, end)]


def parse(data: bytes) -> dict:
    """``tracks {number: {...}}``, ``packets [(track, ms, start, end, key, cluster)]``, ``cues [(ms, track, cluster byte)]``."""
    uint = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0]
    tracks, packets, cues, clusters, scale = {}, [], [], 0, 1_000_000
    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML header")
    for id_, a, b in top:
        if id_ != SEGMENT:
            continue
        for child, c, d in elements(data, a, b):
            if child == INFO:
                scale = next((uint(x, y) for k, x, y in elements(data, c, d) if k == SCALE), scale)
            elif child == TRACKS:
                for k, x, y in elements(data, c, d):
                    if k == TRACK:
                        t = {i: (s, e) for i, s, e in elements(data, x, y)}
                        sound = {i: (s, e) for i, s, e in elements(data, *t[AUDIO])} if AUDIO in t else {}
                        tracks[uint(*t[NUMBER])] = {"codec": data[slice(*t[CODEC])].decode(), "rate": real(*sound[RATE]) if RATE in sound else None, "bits": uint(*sound[DEPTH]) if DEPTH in sound else None}
            elif child == CLUSTER:
                base = 0
                for k, x, y in elements(data, c, d):
                    if k == TIMESTAMP:
                        base = uint(x, y)
                    elif k in (SIMPLE_BLOCK, BLOCK_GROUP):
                        group = list(elements(data, x, y)) if k == BLOCK_GROUP else []
                        x, y = next(((s, e) for i, s, e in group if i == BLOCK), (x, y))
                        track, when, flags, ranges = _frames(data, x, y)
                        key = bool(flags & 0x80) if not group else all(i != REFERENCE for i, _, _ in group)
                        rate = tracks.get(track, {}).get("rate")
                        bytes_ms = (tracks[track]["bits"] or 8) / 8 * rate / 1000 if rate else 0
                        at = (base + when) * scale / 1e6
                        for s, e in ranges:  # frames of one block follow each other
                            packets.append((track, round(at), s, e, key, clusters))
                            at += (e - s) / bytes_ms if bytes_ms else 0
                clusters += 1
            elif child == CUES:
                for k, x, y in elements(data, c, d):
                    if k == CUE_POINT:
                        p = {i: (s, e) for i, s, e in elements(data, x, y)}
                        q = {i: (s, e) for i, s, e in elements(data, *p[CUE_POSITIONS])}
                        cues.append((uint(*p[CUE_TIME]), uint(*q[CUE_TRACK]), a + uint(*q[CUE_CLUSTER])))
    return {"tracks": tracks, "packets": packets, "cues": cues, "clusters": clusters}


def read_pcm(data: bytes) -> tuple[bytes, dict]:
    """The samples of the first track in order of time, and what parse() found."""
    found = parse(data)
    first = min(found["tracks"], default=0)
    ranges = sorted((p[1], p[2], p[3]) for p in found["packets"] if p[0] == first)
    return b"".join(data[s:e] for _, s, e in ranges), found


def feature(samples: bytes, found: dict) -> str:
    """Whole-number features of the decoded sound, and how many packets, clusters and cues held it."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(np.signbit(x))))
    energy = int((x * x).sum())
    peak = int(np.abs(x).max(initial=0))
    return f"packets={len(found['packets'])};clusters={found['clusters']};cues={len(found['cues'])};sum={int(x.sum())};energy={energy};peak={peak};crossings={crossings}"


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 padded with spaces to a positive multiple of the frame, and its length before that."""
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % FRAME if raw else FRAME), len(raw)


def store_texts(docs: DataFrame, lacing: int = FIXED) -> DataFrame:
    """``(doc_id, n_bytes, media)``: each text's bytes as sound in a Matroska file.

    A null text counts as empty; other columns are left out; repeated rows give repeated rows.
    """

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                b = whole.slice(at, _ROWS)
                made = [payload(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for _, n in made], pa.int64()), pa.array([write_pcm(p, lacing) for p, _ in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, media binary")


def read_back(media: DataFrame) -> DataFrame:
    """``media`` with ``payload binary, feature string, error string``.

    A null or damaged file gives null payload and feature, and says why in ``error``.
    """

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                b = whole.slice(at, _ROWS)
                got, feats, errors = [], [], []
                for m in b.column("media").to_pylist():
                    try:
                        if m is None:
                            raise ValueError("no media")
                        samples, found = read_pcm(m)
                        got.append(samples), feats.append(feature(samples, found)), errors.append(None)
                    except (ValueError, KeyError, IndexError, struct.error) as e:
                        got.append(None), feats.append(None), errors.append(str(e) or type(e).__name__)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary()), pa.array(feats, pa.string()), pa.array(errors, pa.string())], [*b.schema.names, "payload", "feature", "error"])

    kept = media.drop("payload", "feature", "error")
    return kept.mapInArrow(run, kept.select("*", F.lit(None).cast("binary").alias("payload"), F.lit(None).cast("string").alias("feature"), F.lit(None).cast("string").alias("error")).schema)


def packet_table(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per packet: key, packet number, track, timestamp_ms, byte range, keyframe and cluster.

    Null and damaged files give no rows.
    """

    def run(batches):
        for b in batches:
            for k, m in zip(b.column("k").to_pylist(), b.column("m").to_pylist(), strict=True):
                try:
                    packets = parse(m)["packets"] if m is not None else []
                except (ValueError, KeyError, IndexError, struct.error):
                    continue
                cols = list(zip(*packets, strict=True)) if packets else [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(packets), b.schema.field("k").type), pa.array(range(len(packets)), pa.int64()), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32()), strict=True))],
                    [key, "packet", "track", "timestamp_ms", "byte_start", "byte_end", "keyframe", "cluster"],
                )

    kind = dict(media.dtypes)[key]
    return media.select(F.col(key).alias("k"), F.col(column).alias("m")).mapInArrow(run, f"`{key}` {kind}, packet long, track int, timestamp_ms long, byte_start long, byte_end long, keyframe boolean, cluster int")
