"""Media columns: Matroska files as binary columns, parsed into packet tables.

`parse` reads variable-length EBML elements (unknown sizes included), clusters, simple and grouped
blocks with every lacing, and cues, into packets with track, timestamp and byte range. `mux` writes a
payload as 8-bit PCM, a frame of 576 samples a packet, several packets a laced block. Broken bytes
give the packets read so far and `ok` false; null media give no packet.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sphera.llm.kernels import slices, table

FRAME = 576
RATE = 8000
LACE = 8  # frames a block
CLUSTER = 64  # frames a cluster

# Element ids of the Matroska and EBML specifications (RFC 8794, RFC 9559).
EBML, SEGMENT, INFO, SCALE, TRACKS, TRACK = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE
NUMBER, UID, KIND, CODEC, LACING, AUDIO, FREQUENCY, CHANNELS, DEPTH = 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_ID, TIME, SIMPLE, GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE, CUE_TIME, CUE_AT, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE = 0x4282
_PARENTS = {SEGMENT, TRACKS, TRACK, AUDIO, CLUSTER_ID, GROUP, CUES, CUE, CUE_AT, INFO}


class Packet(NamedTuple):
    track: int
    timestamp: int  # in ticks of the file's timestamp scale; frames of a lace share their block's
    frame: int  # place in its lace
    offset: int
    size: int
    cluster: int  # offset of its cluster


class Media(NamedTuple):
    packets: list[Packet]
    cues: list[tuple[int, int, int]]  # time, track, offset of the cluster from the segment's data
    tracks: list[dict]
    scale: int
    ok: bool


def vint(data: bytes, at: int, mark: bool = False) -> tuple[int, int]:
    """The number at `at` and where it ends; -1 if all its bits are ones (an unknown size). mark: keep the length marker, as ids do."""
    first = data[at]
    if not first:
        raise ValueError("a number of over 8 bytes")
    size = 9 - first.bit_length()
    if at + size > len(data):
        raise ValueError("a number beyond the end")
    value = int.from_bytes(data[at : at + size], "big")
    if mark:
        return value, at + size
    value &= (1 << 7 * size) - 1
    return (-1 if value == (1 << 7 * size) - 1 else value), at + size


def put_vint(value: int, size: int = 0) -> bytes:
    size = size or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * size).to_bytes(size, "big")


def element(key: int, body: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + put_vint(len(body)) + body


def number(key: int, value: int) -> bytes:
    return element(key, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _lace_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and where the first begins. kind: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if not kind:
        return [end - at], at
    count, at = data[at] + 1, at + 1
    if kind == 2:
        if (end - at) % count:
            raise ValueError("a fixed lace of uneven frames")
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    for i in range(count - 1):
        if kind == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            begin = at
            size, at = vint(data, at)
            if i:
                size = sizes[-1] + size - ((1 << 7 * (at - begin) - 1) - 1)
        sizes.append(size)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise ValueError("a lace longer than its block")
    return [*sizes, last], at


def parse(data: bytes | None) -> Media:
    packets: list[Packet] = []
    cues: list[list[int]] = []
    tracks: list[dict] = []
    scale, ok, cluster, time, segment = 1_000_000, True, 0, 0, 0
    data = data or b""
    ends = [len(data)]
    at = 0
    try:
        while at < len(data):
            while len(ends) > 1 and at >= ends[-1]:
                ends.pop()
            start = at
            key, at = vint(data, at, mark=True)
            size, at = vint(data, at)
            end = ends[-1] if size < 0 else at + size
            if end > len(data):
                raise ValueError("an element beyond the end")
            if key in _PARENTS:
                if key == SEGMENT:
                    segment = at
                elif key == CLUSTER_ID:
                    cluster, time = start, 0
                elif key == TRACK:
                    tracks.append({})
                elif key == CUE:
                    cues.append([0, 0, 0])
                ends.append(end)
                continue
            if key == TIME:
                time = int.from_bytes(data[at:end], "big")
            elif key in (SIMPLE, BLOCK):
                track, to = vint(data, at)
                shift, flags = struct.unpack_from(">hB", data, to)
                sizes, to = _lace_sizes(data, to + 3, end, flags >> 1 & 3)
                for i, n in enumerate(sizes):
                    packets.append(Packet(track, time + shift, i, to, n, cluster))
                    to += n
            elif key == SCALE:
                scale = int.from_bytes(data[at:end], "big")
            elif key in (NUMBER, KIND, CHANNELS, DEPTH) and tracks:
                tracks[-1][key] = int.from_bytes(data[at:end], "big")
            elif key == CODEC and tracks:
                tracks[-1][key] = data[at:end].decode("ascii", "replace")
            elif key in (CUE_TIME, CUE_TRACK, CUE_CLUSTER) and cues:
                cues[-1][{CUE_TIME: 0, CUE_TRACK: 1, CUE_CLUSTER: 2}[key]] = int.from_bytes(data[at:end], "big")
            at = end
    except (ValueError, IndexError, struct.error):
        ok = False
    return Media(packets, [(t, k, c + segment) for t, k, c in cues], tracks, scale, ok)


def _block(payload: bytes, at: int, to: int, shift: int, lacing: int) -> bytes:
    frames = range(at, to, FRAME)
    head = b"\x81" + struct.pack(">hB", shift, 0x80 | lacing << 1)
    if len(frames) == 1:
        return element(SIMPLE, head[:3] + b"\x80" + payload[at:to])
    head += bytes([len(frames) - 1])
    if lacing == 3:
        head += put_vint(FRAME) + put_vint((1 << 6) - 1, 1) * (len(frames) - 2)
    elif lacing == 1:
        head += (b"\xff" * (FRAME // 255) + bytes([FRAME % 255])) * (len(frames) - 1)
    return element(SIMPLE, head + payload[at:to])


_HEAD = element(EBML, element(DOC_TYPE, b"matroska"))
_SETUP = element(INFO, number(SCALE, 1_000_000)) + element(
    TRACKS,
    element(
        TRACK,
        number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(LACING, 1) + element(CODEC, b"A_PCM/INT/LIT")
        + element(AUDIO, element(FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(DEPTH, 8)),
    ),
)


def mux(payload: bytes, lacing: int = 3) -> bytes:
    """A file with one track of 8-bit samples; payload: a positive multiple of FRAME bytes."""
    body, cues = [_SETUP], []
    at = len(_SETUP)
    step = 1000 * FRAME // RATE
    for first in range(0, len(payload), CLUSTER * FRAME):
        last = min(len(payload), first + CLUSTER * FRAME)
        blocks = [_block(payload, b, min(last, b + LACE * FRAME), (b - first) // FRAME * step, lacing) for b in range(first, last, LACE * FRAME)]
        part = element(CLUSTER_ID, number(TIME, first // FRAME * step) + b"".join(blocks))
        cues.append(element(CUE, number(CUE_TIME, first // FRAME * step) + element(CUE_AT, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(part)
        at += len(part)
    return _HEAD + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % FRAME or FRAME * (not text))


def feature(samples: np.ndarray) -> str:
    """Mean, spread, zero crossings per mille, and mean power (dB) of eight bands over the frames of 576 samples."""
    x = samples.astype(np.float32) - 128
    frames = x.reshape(-1, FRAME)
    power = np.abs(np.fft.rfft(frames, axis=1))[:, 1:] ** 2
    bands = power.mean(0).reshape(8, -1).mean(1)
    crossings = 1000 * np.count_nonzero(np.signbit(x[1:]) != np.signbit(x[:-1])) // len(x)
    return f"{x.mean():.3f} {x.std():.3f} {crossings} " + " ".join(f"{v:.1f}" for v in 10 * np.log10(bands + 1e-6))


def store(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, media: each text's UTF-8 (null: empty), padded with 255 to whole frames, as a Matroska file."""

    def run(batches):
        for rows, data, offsets in slices(batches, "text"):
            raw = data.tobytes()
            media = [mux(padded(raw[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(offsets[1:] - offsets[:-1]), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, n_bytes bigint, media binary")


def packets(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """The packet table: a row a packet with track, timestamp, frame, offset, size, cluster."""

    def run(batches):
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = parse(data.as_py()).packets
                columns = list(zip(*found, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_pydict({key: pa.array([k] * len(found), batch.schema.types[0])} | {n: pa.array(c, pa.int64()) for n, c in zip(Packet._fields, columns, strict=True)})

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, "media").mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{n} bigint" for n in Packet._fields))


def digests(media: DataFrame) -> DataFrame:
    """What op6 returns, from the stored bytes alone (and n_bytes, carried along)."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets"]

    def run(batches):
        for batch in batches:
            rows = []
            for k, n, cell in zip(*[c.to_pylist() for c in batch.columns[:2]], batch.column(2), strict=True):
                data = cell.as_buffer().to_pybytes()
                found = parse(data).packets
                payload = b"".join([data[p.offset : p.offset + p.size] for p in found])
                rows.append((k, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(np.frombuffer(payload, np.uint8)), len(found)))
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows, strict=True), strict=True)), schema=schema)

    schema = pa.schema([(n, pa.string() if "sha256" in n or n == "feature" else pa.int64()) for n in names])
    return media.mapInArrow(run, ", ".join(f"{n} {'string' if schema.field(n).type == pa.string() else 'bigint'}" for n in names))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: sizes, digests and features of every text, stored as Matroska and read back."""
    return digests(store(table(spark, sf_dir, "documents")))
