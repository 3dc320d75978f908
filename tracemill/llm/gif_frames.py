"""Media columns from GIF files: LZW streams decoded, palettes, disposal and transparency applied.

``decode`` follows GIF89a: global and local palettes, interlacing, sub-images, disposal methods 0 to 3,
transparent indices, delays, deferred clear codes. ``frames`` turns a binary column into timed frames with
colour-histogram columns. ``encode_samples`` stores any bytes losslessly as 8-bit samples: 64 samples a row,
at most 1,024 rows a frame, grey palette, LZW with a clear code when the table is full.

Sizes of a file are checked before memory is taken for them: a canvas or sub-image of more than MAX_PIXELS, or
a sub-image that its code stream cannot fill, is damage.

Defined results: a null or empty blob has no frames; a damaged stream keeps the frames before the damage and
sets ``damaged``; missing pixels keep what the canvas had; an empty table gives no rows; repeated rows are
decoded each; other columns are ignored. Work is row by row: nothing is shuffled, one blob is held at a time.
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

from tracemill.llm.common import derive

WIDTH, ROWS = 64, 1024
#: Pixels of the largest canvas or sub-image that is decoded; files that ask for more count as damaged.
MAX_PIXELS = 1 << 24
BINS = 4  # per colour channel


@dataclass
class Frame:
    start_ms: int
    delay_ms: int
    rgb: np.ndarray  # canvas, height x width x 3
    opaque: np.ndarray  # canvas, True where something was drawn
    indices: np.ndarray  # the samples of the sub-image itself
    disposal: int


# -- LZW ---------------------------------------------------------------------------------------------


def _widths(n: int, first: int, bits: int) -> np.ndarray:
    """Code widths for the n codes after a clear, if the table has ``first`` entries then.

    The decoder's table gains its first entry with the second code, and the width grows as soon as the
    next free code no longer fits.
    """
    free = first + np.maximum(np.arange(n) - 1, 0)
    return np.clip(np.frexp(free)[1], bits + 1, 12)


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """Variable-width LZW codes packed from the low bit on."""
    clear, end = 1 << bits, (1 << bits) + 1
    codes, widths = [clear], []
    blocks: list[int] = [0]  # where each run of codes after a clear begins
    if samples:
        table: dict[int, int] = {}
        made: list[int] = []  # codes, each shifted to leave room for the next sample: shifted once, not at every sample
        free, full, get, emit = end + 1 << 8, 4096 << 8, table.get, made.append
        blocks.append(1)
        prefix = samples[0] << 8
        for c in memoryview(samples)[1:]:
            code = get(prefix | c)
            if code is not None:
                prefix = code
                continue
            emit(prefix)
            if free < full:
                table[prefix | c] = free
                free += 256
            else:
                emit(clear << 8)
                blocks.append(len(made) + 1)
                table.clear()
                free = end + 1 << 8
            prefix = c << 8
        emit(prefix)
        codes += (np.array(made, np.int64) >> 8).tolist()
    codes.append(end)
    at = [*blocks[1:], len(codes)] if len(blocks) > 1 else [len(codes)]
    widths.append(np.array([bits + 1]))
    if len(blocks) == 1:
        widths.append(np.full(len(codes) - 1, bits + 1))
    for a, b in zip(at, at[1:], strict=False):
        widths.append(_widths(b - a, end + 1, bits))
    return _pack(np.array(codes, np.uint32), np.concatenate(widths).astype(np.int64))


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    ends = np.cumsum(widths)
    pad = np.zeros(len(codes), np.int64)
    pad[1:] = ends[:-1]
    out = np.zeros(int(ends[-1]) // 8 + 4, np.uint8)
    wide = codes.astype(np.uint32) << (pad % 8).astype(np.uint32)
    byte = pad // 8
    for k in range(3):  # a code touches three bytes at most
        part = ((wide >> np.uint32(8 * k)) & np.uint32(255)).astype(np.float64)
        out[: byte[-1] + k + 1] |= np.bincount(byte + k, part, minlength=byte[-1] + k + 1)[: byte[-1] + k + 1].astype(np.uint8)
    return out[: (int(ends[-1]) + 7) // 8].tobytes()


def _expand(codes: np.ndarray, clear: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(samples of the codes that follow a clear, where each code's begin, how many it has) while the table grows.

    Entry k of the table holds the samples of code k and the first one of the next code, which is what follows them in
    the output: a code is a copy of earlier output, and copies of copies are followed to the sample that they stand for.
    """
    n = len(codes)
    if not n:
        return b"", codes, codes
    if codes[0] >= clear:
        raise ValueError("the first code is no sample")
    at, literal = np.arange(n), codes < clear
    parent = np.where(literal, at, codes - (clear + 2))
    if (parent > at - ~literal).any():
        raise ValueError("a code beyond the table")
    depth, up = (~literal).astype(np.int64), parent
    while (more := depth[up]).any():
        depth, up = depth + more, up[up]
    lengths = depth + 1
    begin = np.cumsum(lengths) - lengths
    total = int(begin[-1] + lengths[-1])
    source = np.arange(total, dtype=np.int32) - np.repeat((begin - begin[parent]).astype(np.int32), lengths)
    samples = np.zeros(total, np.uint8)
    samples[begin[literal]] = codes[literal]
    while not np.array_equal(further := source[source], source):
        source = further
    return samples[source].tobytes(), begin, lengths


def lzw_decode(data: bytes, bits: int, limit: int) -> bytes:
    """At most ``limit`` samples; raises ValueError at a code that cannot stand there."""
    if not 1 <= bits <= 8:
        raise ValueError("samples have 1 to 8 bits")
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(4, np.uint8))).astype(np.uint32)
    whole = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16
    roots = [bytes((i,)) for i in range(clear)] + [b"", b""]
    total, at, out, size = 8 * len(data), 0, [], 0
    steps = _widths(4096 - end, end + 1, bits)
    offsets = np.concatenate(([0], np.cumsum(steps)))
    full_from = len(steps)
    table, index = roots, 0  # index: codes since the last clear
    while size < limit:
        # the next codes, up to a full table, at the widths they have if no clear comes between
        if index < full_from:
            starts = at + offsets[index:-1] - offsets[index]
            widths = steps[index:]
        else:
            starts = at + 12 * np.arange(2048)
            widths = np.full(2048, 12)
        keep = starts + widths <= total
        starts, widths = starts[keep], widths[keep]
        if not len(starts):
            raise ValueError("the stream ends without its end code")
        codes = (whole[starts >> 3] >> (starts & 7).astype(np.uint32)) & ((np.uint32(1) << widths.astype(np.uint32)) - np.uint32(1))
        stop = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stop[0]) if len(stop) else len(codes)
        if index < full_from:  # from a clear on, until the table is full
            part, begin, lengths = _expand(codes[:n].astype(np.int64), clear)
            out.append(part)
        elif n:  # no code adds an entry any more
            if len(table) == len(roots):
                last = out[-1]
                table = roots + [last[a : a + k + 1] for a, k in zip(begin[:-1].tolist(), lengths[:-1].tolist(), strict=True)]
            out.append(b"".join(map(table.__getitem__, codes[:n].tolist())))
        size += len(out[-1]) if n else 0
        if n < len(codes):
            at = int(starts[n] + widths[n])
            if codes[n] == end:
                break
            table, index = roots, 0
        else:
            at = int(starts[-1] + widths[-1])
            index += n
    return b"".join(out)[:limit]


# -- container ---------------------------------------------------------------------------------------


def _sub_blocks(data: bytes) -> bytes:
    out = bytearray()
    for i in range(0, len(data), 255):
        part = data[i : i + 255]
        out.append(len(part))
        out += part
    out.append(0)
    return bytes(out)


def encode_samples(payload: bytes, delay_cs: int = 10) -> bytes:
    """A grey GIF whose samples are the payload, which must fill whole rows."""
    if not payload or len(payload) % WIDTH:
        raise ValueError(f"the payload must fill rows of {WIDTH}")
    height = min(len(payload) // WIDTH, ROWS)
    grey = bytes(v for i in range(256) for v in (i, i, i))
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, height, 0xF7, 0, 0), grey]
    for at in range(0, len(payload), WIDTH * ROWS):
        part = payload[at : at + WIDTH * ROWS]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay_cs, 0) + b"\x00")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08")
        out.append(_sub_blocks(lzw_encode(part)))
    out.append(b"\x3b")
    return b"".join(out)


def _take_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while True:
        n = data[at]
        if not n:
            return b"".join(out), at + 1
        if at + 1 + n > len(data):
            raise ValueError("a sub-block is cut off")
        out.append(data[at + 1 : at + 1 + n])
        at += n + 1


def _palette(data: bytes, at: int, packed: int) -> tuple[np.ndarray, int]:
    n = 2 << (packed & 7)
    colours = np.zeros((256, 3), np.uint8)
    colours[:n] = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(n, 3)
    return colours, at + 3 * n


def _bounded(width: int, height: int) -> None:
    if width * height > MAX_PIXELS:
        raise ValueError("more pixels than are decoded")


def _row_order(height: int) -> np.ndarray:
    """Rows in the order in which an interlaced image stores them."""
    return np.concatenate([np.arange(first, height, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes) -> Iterator[Frame]:
    """Frames as shown: each is the canvas after the sub-image was drawn on it."""
    try:
        if data[:6] not in (b"GIF87a", b"GIF89a"):
            raise ValueError("not a GIF")
        width, height, packed, background, _ = struct.unpack_from("<HHBBB", data, 6)
        at, shared = 13, np.zeros((256, 3), np.uint8)
        if packed & 0x80:
            shared, at = _palette(data, at, packed)
        _bounded(width, height)
        rgb, opaque = np.zeros((height, width, 3), np.uint8), np.zeros((height, width), bool)
        clock, delay, disposal, clear_index = 0, 0, 0, None
        while data[at] != 0x3B:
            kind = data[at]
            if kind == 0x21:
                label, (body, after) = data[at + 1], _take_blocks(data, at + 2)
                if label == 0xF9:
                    flags, delay, index = struct.unpack_from("<BHB", body)
                    disposal, clear_index = flags >> 2 & 7, index if flags & 1 else None
                at = after
                continue
            if kind != 0x2C:
                raise ValueError("neither extension, image nor end")
            x, y, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at, colours = at + 10, shared
            if flags & 0x80:
                colours, at = _palette(data, at, flags)
            bits = data[at]
            body, at = _take_blocks(data, at + 1)
            _bounded(w, h)
            if w * h > (8 * len(body) // (bits + 1) + 1) * 4096:  # no code stands for more samples
                raise ValueError("the stream is too short for its image")
            samples = lzw_decode(body, bits, w * h)
            drawn = np.zeros(w * h, bool)
            drawn[: len(samples)] = True
            indices = np.frombuffer(samples.ljust(w * h, b"\0"), np.uint8).reshape(h, w)
            drawn = drawn.reshape(h, w)
            if flags & 0x40:
                order = _row_order(h)
                indices, drawn = _place(indices, order), _place(drawn, order)
            if clear_index is not None:
                drawn = drawn & (indices != clear_index)
            before = (rgb.copy(), opaque.copy()) if disposal == 3 else None
            y1, x1 = min(height, y + h), min(width, x + w)
            inside = drawn[: max(0, y1 - y), : max(0, x1 - x)]
            seen = indices[: inside.shape[0], : inside.shape[1]]
            if inside.all():
                rgb[y:y1, x:x1] = colours[seen]
            else:
                rgb[y:y1, x:x1][inside] = colours[seen[inside]]
            opaque[y:y1, x:x1] |= inside
            yield Frame(clock, 10 * delay, rgb.copy(), opaque.copy(), indices, disposal)
            clock += 10 * delay
            if disposal == 2:
                rgb[y:y1, x:x1], opaque[y:y1, x:x1] = 0, False
            elif before is not None:
                rgb, opaque = before
            delay, disposal, clear_index = 0, 0, None
    except (IndexError, struct.error) as e:
        raise ValueError("the file is cut off") from e


def _place(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty_like(rows)
    out[order] = rows
    return out


def histogram(frame: Frame) -> np.ndarray:
    """Counts of drawn pixels by BINS**3 colours."""
    c = frame.rgb[frame.opaque].astype(np.int64) * BINS >> 8
    return np.bincount((c[:, 0] * BINS + c[:, 1]) * BINS + c[:, 2], minlength=BINS**3)


# -- columns -----------------------------------------------------------------------------------------

FRAME_FIELDS = "frames array<struct<start_ms:long,delay_ms:long,width:int,height:int,disposal:int,histogram:array<long>>>, damaged boolean"


def frames(media: DataFrame, blob: str, keep: list[str]) -> DataFrame:
    """The kept columns, the timed frames with their colour histograms, and whether the file is damaged."""

    def work(batch: pa.RecordBatch) -> dict:
        out = {"frames": [], "damaged": []}
        for x in batch.column(blob):
            own, damaged = [], False
            try:
                for f in decode(x.as_py()) if x.as_py() else ():
                    own.append({"start_ms": f.start_ms, "delay_ms": f.delay_ms, "width": f.rgb.shape[1], "height": f.rgb.shape[0], "disposal": f.disposal, "histogram": histogram(f)})
            except ValueError:
                damaged = True
            out["frames"].append(own)
            out["damaged"].append(damaged)
        return out

    return derive(media, lambda: work, FRAME_FIELDS, keep)


def padded(text: str) -> tuple[bytes, int]:
    raw = text.encode()
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\0"), len(raw)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every text as samples of a GIF."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def work(batch: pa.RecordBatch) -> dict:
        both = [padded(t.as_py()) for t in batch.column("text")]
        return {"n_bytes": [n for _, n in both], "media": [encode_samples(p) for p, _ in both]}

    return derive(source, lambda: work, "n_bytes long, media binary", ["doc_id"])


DIGEST_FIELDS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(media: DataFrame) -> DataFrame:
    """Read the stored files back: digests of their samples, and the features of their frames."""

    def work(batch: pa.RecordBatch) -> dict:
        out = {f.split()[0]: [] for f in DIGEST_FIELDS.split(", ")}
        for x in batch.column("media"):
            blob, samples, total, ms = x.as_py(), [], np.zeros(BINS**3, np.int64), 0
            for f in decode(blob):
                samples.append(f.indices.tobytes())
                total += histogram(f)
                ms = f.start_ms + f.delay_ms
            payload = b"".join(samples)
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-64:]))
            out["media_bytes"].append(len(blob))
            out["media_sha256"].append(hashlib.sha256(blob).hexdigest())
            colours = ",".join(f"{i}:{n}" for i, n in enumerate(total.tolist()) if n)
            out["feature"].append(f"frames={len(samples)};ms={ms};colours={colours}")
        return out

    return derive(media, lambda: work, DIGEST_FIELDS, ["doc_id", "n_bytes"])
