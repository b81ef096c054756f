"""Media columns: Matroska containers. EBML elements, clusters, lacing and cues are parsed into packet tables."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_arrow

# Fixed values of the Matroska and EBML specifications (RFC 8794, RFC 9559).
EBML, EBML_VERSION, EBML_READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that hold elements.
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
SEEK_HEAD, ATTACHMENTS, CHAPTERS, TAGS = 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367
#: Levels of the elements that end one of unknown size, which those with a level may be.
LEVELS = {EBML: 0, SEGMENT: 0} | dict.fromkeys((SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, ATTACHMENTS, CHAPTERS, TAGS), 1)
NO_LACING, XIPH, FIXED, EBML_LACING = range(4)
LACING = ("none", "xiph", "fixed", "ebml")

#: Samples of one unit: payloads are padded with spaces to a multiple of it, at least one.
UNIT = 192
#: 8-bit samples a second; a unit then lasts 24 ms.
RATE = 8000
#: Blocks of a cluster. Block timestamps are 16-bit milliseconds from the cluster's; 64 blocks of at most 6 * 2 units stay far below.
CLUSTER_BLOCKS = 64
#: Frames (in units) of the blocks in turn, and their lacing.
PATTERN = ((NO_LACING, (1,)), (XIPH, (1, 2, 1)), (FIXED, (1, 1, 1, 1)), (EBML_LACING, (2, 1, 2, 1, 1)))


def vint(value: int, length: int = 0) -> bytes:
    """A size as EBML writes it: leading zero bits count the bytes that follow."""
    length = length or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * length).to_bytes(length, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes of a text (null: none) with spaces up to a positive multiple of UNIT, and how many bytes the text has."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (-len(data) % UNIT or (UNIT if not data else 0)), len(data)


def laced(kind: int, frames: list[bytes]) -> bytes:
    """Frames as the body of a block, behind the sizes that this lacing stores."""
    if kind == NO_LACING:
        return frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING:
        head += vint(sizes[0], 2)
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            head += vint(b - a + (1 << 13) - 1, 2)  # signed: 2 bytes are centred on 2^13 - 1
    return head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """A Matroska file with one 8-bit PCM track that holds the payload, in laced blocks, clusters and cues."""
    head = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(MAX_ID, 4) + number(MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"verimill") + element(WRITING_APP, b"verimill"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body, cues, at, turn = [info, tracks], [], 0, 0
    place = len(info) + len(tracks)
    while at < len(payload):
        began, blocks = at, []
        while at < len(payload) and len(blocks) < CLUSTER_BLOCKS:
            kind, units = PATTERN[turn % len(PATTERN)]
            if len(payload) - at < sum(units) * UNIT:
                kind, units = NO_LACING, (1,)
            start, frames = at, []
            for n in units:
                frames.append(payload[at : at + n * UNIT])
                at += n * UNIT
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", (start - began) * 1000 // RATE, 0x80 | kind << 1) + laced(kind, frames)))
            turn += 1
        cluster = element(CLUSTER, number(TIMESTAMP, began * 1000 // RATE) + b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, began * 1000 // RATE) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, place))))
        body.append(cluster)
        place += len(cluster)
    return head + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


def read_vint(data: bytes, at: int, keep_marker: bool) -> tuple[int, int, int]:
    """Value, length and place behind a variable-length integer; a size of ones only (unknown) comes as -1."""
    first = data[at]
    length = 9 - first.bit_length()
    if length > 8 or at + length > len(data):
        raise ValueError(f"no EBML integer at byte {at}")
    value = int.from_bytes(data[at : at + length], "big")
    if not keep_marker:
        value ^= 1 << 7 * length
        value = -1 if value == (1 << 7 * length) - 1 else value
    return value, length, at + length


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, place of the element, begin and end of its body) of all elements, masters before what they hold.

    An element of unknown size, as live recordings have, ends where an element of its own level or of a parent's begins, at its parent's end at
    the latest; the end given for it is its parent's. Open masters are a stack, so nesting may be of any depth.
    """
    open_ = [(end, -1)]  # the end of each master and, if its size is unknown, its level
    while True:
        while len(open_) > 1 and at >= open_[-1][0]:
            open_.pop()
        stop, _ = open_[-1]
        if at >= stop:
            return
        start = at
        ident, _, at = read_vint(data, at, True)
        size, _, at = read_vint(data, at, False)
        while len(open_) > 1 and LEVELS.get(ident, 9) <= open_[-1][1]:
            open_.pop()
        stop = open_[-1][0]
        body = stop if size < 0 else at + size
        if body > stop:
            raise ValueError(f"the element at byte {start} ends behind its parent")
        if size < 0 and ident not in LEVELS:
            raise ValueError(f"the element at byte {start} can't be of unknown size")
        yield ident, start, at, body
        if ident in MASTERS:
            open_.append((body, LEVELS.get(ident, -1) if size < 0 else -1))
        else:
            at = body


def lace_sizes(data: bytes, kind: int, at: int, end: int) -> tuple[list[int], int]:
    """Sizes of a block's frames, and where the first one begins."""
    if kind == NO_LACING:
        return [end - at], at
    n, at = data[at] + 1, at + 1
    if kind == FIXED:
        if (end - at) % n:
            raise ValueError(f"a lace of {n} equal frames doesn't fill the block that ends at byte {end}")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for i in range(n - 1):
        if kind == XIPH:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            size, length, at = read_vint(data, at, False)
            if i:
                size += sizes[-1] - (1 << 7 * length - 1) + 1
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"the lace of the block that ends at byte {end} has a frame of less than no bytes")
    return sizes, at


def packets(data: bytes) -> dict[str, list]:
    """The packet table of a Matroska file, one entry a frame, with what the cues say.

    Columns: track, timestamp_ns (of the block, frames of a lace share it), keyframe, lacing, offset and size (byte range in the file),
    cluster (its number). `cues` is [(time, byte place of the cluster it points to)], `clusters` the clusters' places.
    """
    out: dict[str, list] = {k: [] for k in ("track", "timestamp_ns", "keyframe", "lacing", "offset", "size", "cluster", "cues", "clusters")}
    scale, base, segment, cue_time, bits, rate = 1_000_000, 0, 0, 0, 0, 0.0
    for ident, start, begin, end in elements(data, 0, len(data)):
        if ident == SEGMENT:
            segment = begin
        elif ident == TIMESTAMP_SCALE:
            scale = int.from_bytes(data[begin:end], "big")
        elif ident == CLUSTER:
            out["clusters"].append(start)
        elif ident == TIMESTAMP:
            base = int.from_bytes(data[begin:end], "big")
        elif ident == BIT_DEPTH:
            bits = int.from_bytes(data[begin:end], "big")
        elif ident == SAMPLING_FREQUENCY:
            rate = struct.unpack(">f" if end - begin == 4 else ">d", data[begin:end])[0]
        elif ident == CUE_TIME:
            cue_time = int.from_bytes(data[begin:end], "big")
        elif ident == CUE_CLUSTER_POSITION:
            out["cues"].append((cue_time, segment + int.from_bytes(data[begin:end], "big")))
        elif ident in (SIMPLE_BLOCK, BLOCK):
            track, _, at = read_vint(data, begin, False)
            relative, flags = struct.unpack_from(">hB", data, at)
            kind = flags >> 1 & 3
            if abs(base + relative) * scale >= 1 << 63:
                raise ValueError(f"the block at byte {start} has a time beyond 292 years")
            sizes, at = lace_sizes(data, kind, at + 3, end)
            for size in sizes:
                for k, v in (("track", track), ("timestamp_ns", (base + relative) * scale), ("keyframe", bool(flags & 0x80)), ("lacing", kind), ("offset", at), ("size", size), ("cluster", len(out["clusters"]) - 1)):
                    out[k].append(v)
                at += size
    return out | {"bits": [bits], "rate": [rate]}


def payload_of(data: bytes, table: dict[str, list], track: int = 1) -> bytes:
    return b"".join(data[a : a + n] for t, a, n in zip(table["track"], table["offset"], table["size"], strict=True) if t == track)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id and media (binary): every whole text as a Matroska file; a null text as an empty one."""
    schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])
    return in_arrow(docs.select("doc_id", "text"), "doc_id long, media binary", lambda rows: {"doc_id": rows["doc_id"], "media": [mux(padded(x)[0]) for x in rows["text"]]}, schema)


def packet_table(media: DataFrame) -> DataFrame:
    """One row for each packet of each file in `media` (doc_id, media); null media have none. A damaged file has one
    row, with nulls and its error."""
    names = ("track", "timestamp_ns", "keyframe", "lacing", "offset", "size", "cluster")
    schema = pa.schema([("doc_id", pa.int64()), ("track", pa.int64()), ("timestamp_ns", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("cluster", pa.int64()), ("error", pa.string())])

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in schema.names}
        for doc_id, data in zip(rows["doc_id"], rows["media"], strict=True):
            try:
                table, error = packets(data or b""), None
            except (ValueError, IndexError, struct.error) as e:
                table, error = {k: [None] for k in names}, f"{type(e).__name__}: {e}"
            out["doc_id"] += [doc_id] * len(table["track"])
            out["error"] += [error] * len(table["track"])
            for k in names:
                out[k] += [x if x is None else LACING[x] for x in table[k]] if k == "lacing" else table[k]
        return out

    return in_arrow(media.select("doc_id", "media"), "doc_id long, track long, timestamp_ns long, keyframe boolean, lacing string, offset long, size long, cluster long, error string", work, schema, text="media")


def feature(data: bytes, table: dict[str, list], payload: bytes) -> str:
    """What the packet table and the samples show, in one line."""
    kinds = ",".join(f"{name}:{table['lacing'].count(k)}" for k, name in enumerate(LACING))
    clusters = set(table["clusters"])
    cued = sum(place in clusters for _, place in table["cues"])
    mean = sum(payload) // len(payload) if payload else 0
    last = table["timestamp_ns"][-1] // 1_000_000 if table["timestamp_ns"] else 0
    return f"bits={table['bits'][0]};rate={table['rate'][0]:.0f};clusters={len(table['clusters'])};cues={cued};packets={len(table['track'])};lacing={kinds};last_ms={last};mean={mean};peak={max(payload, default=0)}"


def op4_matroska(docs: DataFrame) -> DataFrame:
    """One row a row of docs, repeated ones too. A null text is an empty one, whose payload is one unit of spaces; equal texts, also very long
    ones, have equal values; an empty table gives none; null ids stay; other columns are not read."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in schema.names}
        for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
            source, n = padded(text)
            data = mux(source)
            table = packets(data)
            back = payload_of(data, table)
            for k, v in zip(schema.names, (doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(data, table, back)), strict=True):
                out[k].append(v)
        return out

    return in_arrow(docs.select("doc_id", "text"), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", work, schema)
