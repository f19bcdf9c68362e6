"""Matroska: EBML elements, clusters, lacing and cues parsed into packet tables; and a writer of raw 8-bit audio.

The parser reads variable-length ids and sizes (unknown sizes too), SimpleBlocks and BlockGroups, all four lacings and
the cues, and gives for each packet its track, time in nanoseconds, cluster, byte range and key flag. Damaged bytes
raise ValueError; `packet_table` turns that into an error row. It never reads outside the bytes given.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_documents, texts_of

#: Element ids of Matroska (fixed values).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
#: Elements of the top level and of a segment: they end a cluster or segment of unknown size.
_TOP = {EBML, SEGMENT}
_IN_SEGMENT = _TOP | {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367}

FRAME, LACED, CLUSTER_FRAMES, RATE = 1024, 8, 24, 8000
LACINGS = ("none", "xiph", "fixed", "ebml")


def vint(n: int, length: int = 0) -> bytes:
    """n as a variable-length size."""
    length = length or next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * length).to_bytes(length, "big")


def _signed_vint(n: int) -> bytes:
    length = next(k for k in range(1, 9) if -(1 << 7 * k - 1) < n < 1 << 7 * k - 1)
    return vint(n + (1 << 7 * length - 1) - 1, length)


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], lacing: int) -> bytes:
    """Frames of a block as its lacing stores them."""
    if lacing == 0:
        return frames[0]
    out = bytes([len(frames) - 1])
    sizes = [len(x) for x in frames]
    if lacing == 1:
        out += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == 3:
        out += vint(sizes[0]) + b"".join(_signed_vint(b - a) for a, b in zip(sizes[:-2], sizes[1:-1], strict=True))
    return out + b"".join(frames)


def write_audio(samples: bytes) -> bytes:
    """A Matroska file of one track of unsigned 8-bit samples at 8 kHz, which holds the samples as they are.

    Frames of 1024 samples, eight to a block, 24 to a cluster, with a cue for each cluster. Blocks of equal frames use fixed-size
    lacing, the last one EBML lacing.
    """
    tick = 1_000_000_000 // RATE
    head = element(EBML, element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, tick) + element(MUXING_APP, b"framewake") + element(WRITING_APP, b"framewake"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, b"\x45\xfa\x00\x00") + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, FRAME * tick) + audio))
    parts, at, cues = [info, tracks], len(info) + len(tracks), []
    frames = [samples[i : i + FRAME] for i in range(0, len(samples), FRAME)]
    for c in range(0, len(frames), CLUSTER_FRAMES):
        body = [number(TIMESTAMP, c * FRAME)]
        for b in range(c, min(c + CLUSTER_FRAMES, len(frames)), LACED):
            group = frames[b : min(b + LACED, c + CLUSTER_FRAMES, len(frames))]
            lacing = 0 if len(group) == 1 else 2 if len(group[-1]) == FRAME else 3
            body.append(element(SIMPLE_BLOCK, vint(1) + ((b - c) * FRAME).to_bytes(2, "big") + bytes([0x80 | lacing << 1]) + laced(group, lacing)))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, number(CUE_TIME, c * FRAME) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


@dataclass
class Media:
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    #: (track, time in ns, cluster number, first byte, bytes, key frame, lacing)
    packets: list[tuple[int, int, int, int, int, bool, str]] = field(default_factory=list)
    #: (time in ns, track, cluster's first byte in the file)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)


def _ident(data: bytes, at: int, end: int) -> tuple[int, int]:
    if at >= end or not data[at]:
        raise ValueError(f"no element id at byte {at}")
    length = 9 - data[at].bit_length()
    if length > 4 or at + length > end:
        raise ValueError(f"no element id at byte {at}")
    return int.from_bytes(data[at : at + length], "big"), at + length


def _size(data: bytes, at: int, end: int) -> tuple[int, int]:
    """A size (-1: unknown) and the place after it."""
    if at >= end or not data[at]:
        raise ValueError(f"no size at byte {at}")
    length = 9 - data[at].bit_length()
    if at + length > end:
        raise ValueError(f"a size is cut off at byte {at}")
    n = int.from_bytes(data[at : at + length], "big") & (1 << 7 * length) - 1
    return (-1 if n == (1 << 7 * length) - 1 else n), at + length


def _children(data: bytes, at: int, end: int, until: set[int] = frozenset()):
    """(id, first byte, end) of the elements in data[at:end]; an id of until ends them."""
    while at < end:
        begin = at
        ident, at = _ident(data, at, end)
        if ident in until:
            return
        n, at = _size(data, at, end)
        to = at + n
        if n < 0:
            if ident not in (SEGMENT, CLUSTER):
                raise ValueError(f"unknown size of element {ident:x} at byte {begin}")
            to = at
            stop = _TOP if ident == SEGMENT else _IN_SEGMENT
            for _, _, to in _children(data, at, end, stop):  # noqa: B007
                pass
        if to > end:
            raise ValueError(f"element {ident:x} at byte {begin} is cut off")
        yield ident, at, to
        at = to


def _uint(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def parse(data: bytes) -> Media:
    media = Media()
    first = True
    for ident, at, end in _children(data, 0, len(data)):
        if first and ident != EBML:
            raise ValueError("no EBML header")
        first = False
        if ident == SEGMENT:
            _segment(data, at, end, media)
    if first:
        raise ValueError("no EBML header")
    return media


def _segment(data: bytes, base: int, end: int, media: Media) -> None:
    for ident, at, to in _children(data, base, end):
        if ident == INFO:
            for i, a, b in _children(data, at, to):
                if i == TIMESTAMP_SCALE:
                    media.scale = _uint(data, a, b)
        elif ident == TRACKS:
            for i, a, b in _children(data, at, to):
                if i == TRACK_ENTRY:
                    track = {"type": 0, "codec": "", "frame_ns": 0}
                    for j, c, d in _children(data, a, b):
                        if j == TRACK_NUMBER:
                            media.tracks[_uint(data, c, d)] = track
                        elif j == TRACK_TYPE:
                            track["type"] = _uint(data, c, d)
                        elif j == CODEC_ID:
                            track["codec"] = data[c:d].decode("ascii", "replace")
                        elif j == DEFAULT_DURATION:
                            track["frame_ns"] = _uint(data, c, d)
        elif ident == CLUSTER:
            media.clusters.append(at)
            now = 0
            for i, a, b in _children(data, at, to):
                if i == TIMESTAMP:
                    now = _uint(data, a, b)
                elif i == SIMPLE_BLOCK:
                    _block(data, a, b, now, media, None)
                elif i == BLOCK_GROUP:
                    inside = list(_children(data, a, b))
                    key = all(j != REFERENCE for j, _, _ in inside)
                    for j, c, d in inside:
                        if j == BLOCK:
                            _block(data, c, d, now, media, key)
        elif ident == CUES:
            for i, a, b in _children(data, at, to):
                if i == CUE_POINT:
                    time = 0
                    for j, c, d in _children(data, a, b):
                        if j == CUE_TIME:
                            time = _uint(data, c, d)
                        elif j == CUE_POSITIONS:
                            where = {k: _uint(data, e, f) for k, e, f in _children(data, c, d)}
                            media.cues.append((time * media.scale, where.get(CUE_TRACK, 0), base + where.get(CUE_CLUSTER, 0)))


def _block(data: bytes, at: int, end: int, now: int, media: Media, key: bool | None) -> None:
    track, at = _size(data, at, end)
    if at + 3 > end:
        raise ValueError(f"a block is cut off at byte {at}")
    time = now + int.from_bytes(data[at : at + 2], "big", signed=True)
    flags = data[at + 2]
    at += 3
    lacing = flags >> 1 & 3
    if lacing == 0:
        sizes = [end - at]
    else:
        if at >= end:
            raise ValueError(f"a block is cut off at byte {at}")
        n = data[at] + 1
        at += 1
        if lacing == 2:
            if (end - at) % n:
                raise ValueError(f"fixed lacing does not divide the block at byte {at}")
            sizes = [(end - at) // n] * n
        else:
            sizes = []
            for k in range(n - 1):
                if lacing == 1:
                    size = 0
                    while True:
                        if at >= end:
                            raise ValueError(f"a lace is cut off at byte {at}")
                        size += data[at]
                        at += 1
                        if data[at - 1] < 255:
                            break
                else:
                    begin = at
                    size, at = _size(data, at, end)
                    if k:
                        size = sizes[-1] + size - ((1 << 7 * (at - begin) - 1) - 1)
                sizes.append(size)
            sizes.append(end - at - sum(sizes))
        if min(sizes) < 0:
            raise ValueError(f"laces exceed the block at byte {at}")
    step = media.tracks.get(track, {}).get("frame_ns", 0)
    for k, size in enumerate(sizes):
        media.packets.append((track, time * media.scale + k * step, len(media.clusters) - 1, at, size, bool(flags & 0x80) if key is None else key, LACINGS[lacing]))
        at += size


def payload_of(text: str) -> tuple[int, bytes]:
    """A text's length in UTF-8, and these bytes with bytes 0 up to a positive multiple of 64."""
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def features(media: Media, payload: bytes) -> str:
    """Packets, clusters, cues, blocks by lacing, duration, and the samples' sum, energy and crossings of the middle."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    lacing = "/".join(str(sum(p[6] == k for p in media.packets)) for k in LACINGS)
    end = max((p[1] for p in media.packets), default=0)
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};lacing={lacing};last_ns={end};sum={int(x.sum())};energy={int((x * x).sum())};crossings={int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))}"


MEDIA_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(docs: DataFrame) -> DataFrame:
    """Every text stored as samples of a Matroska file, parsed back, and the digests of what the packets hold.

    Null and empty texts are 64 bytes 0. Equal texts give equal files. Repeated rows give repeated results; an empty table none.
    """

    def run(batches):
        for block in batches:
            rows = []
            for doc, text in zip(block.column("doc_id").to_pylist(), texts_of(block), strict=True):
                n, payload = payload_of(text)
                stored = write_audio(payload)
                media = parse(stored)
                back = b"".join(stored[at : at + size] for _, _, _, at, size, _, _ in sorted(media.packets, key=lambda p: p[1]))
                rows.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(media, back)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if isinstance(kind, int) else pa.string()) for c, kind in zip(cols, (1, 1, 1, "", 1, 1, "", ""), strict=True)], [x.split()[0] for x in MEDIA_SCHEMA.split(", ")])

    return map_documents(docs, run, MEDIA_SCHEMA)


PACKET_SCHEMA = "track long, time_ns long, cluster long, first_byte long, n_bytes long, is_key boolean, lacing string, error string"


def packet_table(files: DataFrame, key: str, content: str) -> DataFrame:
    """One row for each packet of each file (a binary column); a null, empty or damaged file gives one row with error set."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k, data in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    rows = [(*p, None) for p in parse(data.as_py() or b"").packets]
                except ValueError as e:
                    rows = [(None,) * 7 + (str(e),)]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    arrays = [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 5 + [pa.bool_(), pa.string(), pa.string()], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.repeat(k, len(rows)), *arrays], [key, *(x.split()[0] for x in PACKET_SCHEMA.split(", "))])

    return files.select(key, content).mapInArrow(run, f"`{key}` {kind}, {PACKET_SCHEMA}")
