"""GIF media columns: encode and decode LZW code streams, palettes, disposal, transparency, timed frames.

encode_all() writes payloads as animations: frames of FRAME_ROWS rows in a colour palette whose red is the
sample. Of every KEY_FRAMES frames the first is drawn on an empty canvas; in the others a row that equals
the one shown below it is written as transparent; the last one's disposal empties the canvas again. All
streams of a batch step through their samples together, and their codes are packed together.
parse(), fill() and compose() read any GIF87a/89a file: global and local palettes, interlacing, graphic-control delays,
transparent indexes, disposal methods 0 to 3. LZW is decoded in numpy: between two clear codes the
code widths follow from the position alone, every table entry is a copy of earlier output, and the
chains of prefixes are resolved by pointer doubling, all streams of a batch together.

Edge cases: a null payload is stored as an empty one (padded, so one row of zeros); null media gives
no frames; broken media (bad signature, truncated blocks) gives no frames and `error` set; equal
payloads give equal files. Long payloads become several frames. Frames that hold the transparent index
as a sample are written without transparency.
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

UNIT, FRAME_ROWS, KEY_FRAMES, DELAY_CS, HIST_BINS = 64, 56, 4, 10, 8
CLEAR, END, FIRST = 256, 257, 258  # a frame of UNIT * FRAME_ROWS samples cannot fill the table of 4096
TRANSPARENT = 255  # no byte of UTF-8
SLOTS = 1 << 13
ENCODE_BYTES, DECODE_BYTES = 4_000_000, 1_000_000  # of payloads, of media, at once
#: index -> red (the index itself), green (its bits reversed), blue
PALETTE = np.array([(i, int(f"{i:08b}"[::-1], 2), (7 * i + 85) % 256) for i in range(256)], np.uint8)


# -- LZW ---------------------------------------------------------------------------------------

def lzw_codes(samples: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of many streams (samples one after the other, each of 1 to UNIT * FRAME_ROWS), and how many each has.

    All streams advance one sample at a time. Table entries are found by a hash of (prefix, sample) into
    SLOTS places for each stream, the newest entry keeping its place; an entry that lost it is never used
    again, which any decoder may ignore.
    """
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], lengths[order]
    active = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1), side="right")  # streams longer than each position
    table = np.full(len(order) * SLOTS, 0xFFFFFFFF, np.uint32)
    base = np.arange(len(order)) * SLOTS
    out, count = np.empty(len(samples), np.int32), np.zeros(len(order), np.int64)
    prefix = samples[at].astype(np.uint32)
    for t in range(1, int(left[0])):
        a = active[t]
        own, b = prefix[:a], samples[at[:a] + t].astype(np.uint32)
        key = own << np.uint32(8) | b
        place = base[:a] + (key * np.uint32(0x9E3779B1) >> np.uint32(19))
        found = table[place]
        miss = np.flatnonzero(found >> np.uint32(12) != key)
        told = own[miss]
        out[at[miss] + count[miss]] = told
        table[place[miss]] = key[miss] << np.uint32(12) | (FIRST + count[miss]).astype(np.uint32)
        count[miss] += 1
        own[:] = found & np.uint32(4095)
        own[miss] = b[miss]
    out[at + count] = prefix
    count += 1
    n = np.empty(len(order), np.int64)
    n[order] = count
    keep = np.arange(int(n.sum())) + np.repeat(starts - (np.cumsum(n) - n), n)
    return out[keep], n


def _widths(count: int, min_bits: int) -> np.ndarray:
    """Bits of the 1st, 2nd, ... code after a clear code, as a decoder reads them."""
    entries = (1 << min_bits) + 2 + np.maximum(np.arange(count) - 1, 0)  # table size when the code is read
    return np.minimum(12, np.floor(np.log2(np.maximum(entries, 2))).astype(np.int64) + 1)


_WIDTHS = {m: _widths(1 << 16, m) for m in range(2, 9)}


_BEGIN = {m: np.cumsum(w) - w + m + 1 for m, w in _WIDTHS.items()}  # first bit of each code, behind a clear code


def pack(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all streams, each a clear code, its n codes and an end code; where each stream ends."""
    width, begin = _WIDTHS[8], _BEGIN[8]
    ends = np.cumsum((begin[n] + width[n] + 7) >> 3)
    first = 8 * np.append(0, ends[:-1])
    k = np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n)
    bit = np.concatenate([first, first.repeat(n) + begin[k], first + begin[n]])
    value = np.concatenate([np.full(len(n), CLEAR), codes, np.full(len(n), END)]).astype(np.int64) << (bit & 7)
    byte, size = bit >> 3, int(ends[-1]) + 3
    out = sum(np.bincount(byte + i, value >> 8 * i & 255, size) for i in range(3))  # bits never overlap: sums are unions
    return out[: ends[-1]].astype(np.uint8), ends


def unpack(stream: bytes, min_bits: int) -> list[np.ndarray]:
    """The code segments between clear codes, clear and end codes left out."""
    clear, end = 1 << min_bits, (1 << min_bits) + 1
    bits = np.unpackbits(np.frombuffer(stream, np.uint8), bitorder="little")
    weights = (1 << np.arange(12)).astype(np.int32)
    at, segments, own, count = 0, [], [], 0
    edges = np.flatnonzero(np.diff(_WIDTHS[min_bits][:8192])) + 1  # where the width grows
    while True:
        width = int(_WIDTHS[min_bits][min(count, 8191)])
        nxt = int(edges[np.searchsorted(edges, count, side="right")]) if count < edges[-1] else count + 65536
        n = min(nxt - count, (len(bits) - at) // width)
        if n <= 0:
            break
        run = bits[at : at + n * width].reshape(n, width) @ weights[:width]
        stop = np.flatnonzero((run == clear) | (run == end))
        if not len(stop):
            own.append(run)
            at, count = at + n * width, count + n
            continue
        k = int(stop[0])
        own.append(run[:k])
        at += (k + 1) * width
        segments.append(np.concatenate(own))
        own, count = [], 0
        if run[k] == end:
            break
    if own:
        segments.append(np.concatenate(own))
    return [s for s in segments if len(s)]


def unpack_all(streams: list[bytes], min_bits: int) -> list[list[np.ndarray]]:
    """unpack() of many streams; those with one segment, whose bits are all at known places, at once."""
    clear, end = 1 << min_bits, (1 << min_bits) + 1
    width, begin = _WIDTHS[min_bits], _BEGIN[min_bits]
    sizes = np.array([len(x) for x in streams])
    n = np.minimum(np.searchsorted(begin + width, 8 * sizes, side="right"), len(width))
    data = np.frombuffer(b"".join(streams) + b"\0\0\0", np.uint8).astype(np.int64)
    first = np.cumsum(n) - n
    at = np.cumsum(sizes) - sizes
    k = np.arange(int(n.sum())) - np.repeat(first, n)
    bit = np.repeat(8 * at, n) + begin[k]
    byte = bit >> 3
    codes = (data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (bit & 7) & ((1 << width[k]) - 1)
    stops = np.flatnonzero((codes == clear) | (codes == end))
    nearest = np.append(stops, len(codes))[np.searchsorted(stops, first)]
    opens = (data[at] | data[at + 1] << 8) & ((2 << min_bits) - 1) == clear
    out = []
    for i, stream in enumerate(streams):
        stop = int(nearest[i])
        if opens[i] and stop < first[i] + n[i] and codes[stop] == end:
            out.append([codes[first[i] : stop]] if stop > first[i] else [])
        else:
            out.append(unpack(stream, min_bits))
    return out


def expand(segments: list[np.ndarray], min_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples of all segments, decoded together; where each segment begins.

    Entry e of a segment is the output of its code e plus the first sample of code e + 1, so a
    code points to its prefix code and nothing has to be looked up in order.
    """
    if not segments:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    base = (1 << min_bits) + 2
    sizes = np.array([len(s) for s in segments])
    offset = np.repeat(np.cumsum(sizes) - sizes, sizes)
    code = np.concatenate(segments).astype(np.int64)
    index = np.arange(len(code))
    literal = code < base
    parent = np.where(literal, index, code - base + offset)
    if (parent > index).any() or (~literal & (parent >= index)).any():
        raise ValueError("a code refers to an entry that does not exist yet")
    root, depth, jump = parent.copy(), (~literal).astype(np.int64), parent.copy()
    while True:
        further = depth[jump]
        if not further.any():
            break
        depth = depth + further
        jump = jump[jump]
    root = jump
    first = code[root]
    last = np.where(literal, code, first[np.minimum(parent + 1, len(code) - 1)])
    length = depth + 1
    stop = np.cumsum(length)
    out = np.empty(int(stop[-1]), np.uint8)
    at, live = stop - 1, index
    node = index
    while len(live):
        out[at] = last[node]
        more = ~literal[node]
        at, node = at[more] - 1, parent[node[more]]
        live = node
    starts = np.append(0, stop[np.cumsum(sizes) - 1])
    return out, starts


# -- container ---------------------------------------------------------------------------------

def _blocks(payload: bytes) -> bytes:
    return b"".join(bytes([len(payload[i : i + 255])]) + payload[i : i + 255] for i in range(0, len(payload), 255)) + b"\0"


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of UNIT bytes) as a file of frames, UNIT pixels wide."""
    streams, shapes = [], []
    for payload in payloads:
        rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        for k, top in enumerate(range(0, len(rows), FRAME_ROWS)):
            own, see = rows[top : top + FRAME_ROWS], False
            if k % KEY_FRAMES:
                same = (own == rows[top - FRAME_ROWS : top - FRAME_ROWS + len(own)]).all(1)
                see = bool(same.any()) and not (own == TRANSPARENT).any()
                if see:
                    own = np.where(same[:, None], np.uint8(TRANSPARENT), own)
            streams.append(own.ravel())
            shapes.append((len(own), 2 if k % KEY_FRAMES == KEY_FRAMES - 1 else 1, see))
    codes, n = lzw_codes(np.concatenate(streams), np.array([len(x) for x in streams]))
    packed, ends = pack(codes, n)
    packed, begins = packed.tobytes(), [0, *ends.tolist()]
    out, f = [], 0
    for payload in payloads:
        rows = len(payload) // UNIT
        parts = [b"GIF89a", struct.pack("<HHBBB", UNIT, min(rows, FRAME_ROWS), 0xF7, 0, 0), PALETTE.tobytes()]
        for _ in range(0, rows, FRAME_ROWS):
            height, disposal, see = shapes[f]
            parts.append(b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | see, DELAY_CS, TRANSPARENT if see else 0, 0))
            parts.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, UNIT, height, 0) + b"\x08")
            parts.append(_blocks(packed[begins[f] : begins[f + 1]]))
            f += 1
        out.append(b"".join(parts) + b"\x3b")
    return out


def encode(payload: bytes) -> bytes:
    return encode_all([payload])[0]


@dataclass
class Frame:
    """One image of a file as stored: its rectangle, palette, timing, and its code stream."""

    left: int
    top: int
    width: int
    height: int
    palette: np.ndarray
    delay_ms: int
    disposal: int
    transparent: int
    interlaced: bool
    min_bits: int
    stream: bytes
    samples: np.ndarray | None = None


def parse(media: bytes) -> tuple[int, int, list[Frame]]:
    """Canvas size and frames, LZW still packed."""
    if media[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    width, height, flags = struct.unpack_from("<HHB", media, 6)
    at, shared = 13, None

    def palette(bits: int) -> np.ndarray:
        nonlocal at
        n = 3 << (bits + 1)
        at += n
        return np.frombuffer(media, np.uint8, n, at - n).reshape(-1, 3)

    if flags & 0x80:
        shared = palette(flags & 7)
    frames, control = [], (0, 0, -1)
    while at < len(media) and media[at] != 0x3B:
        kind = media[at]
        if kind == 0x21:
            if media[at + 1] == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", media, at + 3)
                control = (delay * 10, packed >> 2 & 7, index if packed & 1 else -1)
            at += 2
            while media[at]:
                at += media[at] + 1
            at += 1
        elif kind == 0x2C:
            left, top, w, h, packed = struct.unpack_from("<HHHHB", media, at + 1)
            at += 10
            own = palette(packed & 7) if packed & 0x80 else shared
            if own is None:
                raise ValueError("no palette")
            min_bits, at = media[at], at + 1
            if not 2 <= min_bits <= 8:
                raise ValueError("bad code size")
            stream = []
            while media[at]:
                stream.append(media[at + 1 : at + 1 + media[at]])
                at += media[at] + 1
            at += 1
            frames.append(Frame(left, top, w, h, own, *control, bool(packed & 0x40), min_bits, b"".join(stream)))
            control = (0, 0, -1)
        else:
            raise ValueError(f"unknown block {kind}")
    return width, height, frames


def fill(frames: list[Frame]) -> None:
    """Decode the samples of many frames together."""
    for bits in {f.min_bits for f in frames}:
        own = [f for f in frames if f.min_bits == bits]
        segments = unpack_all([f.stream for f in own], bits)
        out, starts = expand([s for x in segments for s in x], bits)
        k = 0
        for f, x in zip(own, segments):
            samples = out[starts[k] : starts[k + len(x)]]
            k += len(x)
            if len(samples) < f.width * f.height:
                raise ValueError("too few samples")
            samples = samples[: f.width * f.height].reshape(f.height, f.width)
            if f.interlaced:
                order = [y for a, b in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(a, f.height, b)]
                plain = np.empty_like(samples)
                plain[order] = samples
                samples = plain
            f.samples = samples


def compose(width: int, height: int, frames: list[Frame]) -> Iterator[np.ndarray]:
    """The RGBA canvas shown with each frame, transparency and disposal applied."""
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        rect = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        samples = f.samples[: rect.shape[0], : rect.shape[1]]
        colour = np.concatenate([f.palette, np.full((len(f.palette), 1), 255, np.uint8)], axis=1)
        shown = samples != f.transparent if f.transparent >= 0 else np.ones(samples.shape, bool)
        rect[shown] = colour[np.minimum(samples, len(colour) - 1)][shown]
        yield canvas
        if f.disposal == 2:
            rect[:] = 0
        elif f.disposal == 3:
            canvas = before


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Counts of HIST_BINS levels of red, green and blue over the opaque pixels."""
    seen = rgba[rgba[..., 3] > 0]
    return np.concatenate([np.bincount(seen[:, c] >> 5, minlength=HIST_BINS) for c in range(3)]) if len(seen) else np.zeros(3 * HIST_BINS, np.int64)


# -- DataFrame operators -------------------------------------------------------------------------

def pad(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % UNIT or (0 if payload else UNIT))


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each text's UTF-8 bytes, padded, as a GIF file."""
    rows = docs.select(F.col(key).alias("media_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = batch.column(1).to_pylist(), 0
            while at < len(raw):
                end, held = at, 0
                while end < len(raw) and (end == at or held + len(raw[end]) <= ENCODE_BYTES):
                    held += len(raw[end]) + UNIT
                    end += 1
                own = raw[at:end]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at), pa.array([len(x) for x in own], pa.int64()), pa.array(encode_all([pad(x) for x in own]), pa.binary())], ["media_id", "n_bytes", "media"]
                )
                at = end

    kind = rows.schema["media_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"media_id {kind}, n_bytes bigint, media binary")


def _decoded(media: list, most: int = DECODE_BYTES) -> Iterator[tuple[int, tuple[int, int, list[Frame]] | None, str | None]]:
    """(row, canvas and frames, error) for each file, files of about `most` bytes decoded together."""
    at = 0
    while at < len(media):
        end, held = at, 0
        while end < len(media) and (end == at or held < most):
            held += len(media[end] or b"")
            end += 1
        parsed, errors = {}, {}
        for i, m in enumerate(media[at:end], at):
            try:
                parsed[i] = parse(m) if m is not None else None
            except (ValueError, IndexError, struct.error) as e:
                errors[i] = f"{type(e).__name__}: {e}"
        try:
            fill([f for p in parsed.values() if p for f in p[2]])
        except ValueError:  # find the broken files one by one
            for i, p in parsed.items():
                try:
                    fill(p[2] if p else [])
                except ValueError as e:
                    errors[i] = str(e)
        for i in range(at, end):
            yield i, None if i in errors else parsed[i], errors.get(i)
        at = end


def timed(width: int, height: int, frames: list[Frame]) -> Iterator[tuple[Frame, int, np.ndarray, np.ndarray]]:
    """(frame, start in ms, canvas shown, colour histogram of the frame's rectangle)."""
    when = 0
    for f, shown in zip(frames, compose(width, height, frames)):
        yield f, when, shown, histogram(shown[f.top : f.top + f.height, f.left : f.left + f.width])
        when += f.delay_ms


def frames(media: DataFrame) -> DataFrame:
    """One row a frame of (media_id, media): times, rectangle, composited RGBA pixels, colour histograms."""
    kind = media.schema["media_id"].dataType.simpleString()
    names = ["media_id", "frame", "start_ms", "delay_ms", "width", "height", "disposal", "transparent", "rgba", "hist_r", "hist_g", "hist_b", "error"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 3, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, got, error in _decoded(batch.column(1).to_pylist()):
                rows = [(None,) * 11 + (error,)] if error else []
                if got:
                    rows = [(k, when, f.delay_ms, *got[:2], f.disposal, f.transparent, shown.tobytes(), *h.reshape(3, -1).tolist(), None) for k, (f, when, shown, h) in enumerate(timed(*got))]
                for at in range(0, len(rows), 256):
                    own = rows[at : at + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i].as_py()] * len(own), ids.type), *[pa.array(c, t) for c, t in zip(zip(*own), types)]], names)

    return media.select("media_id", "media").mapInArrow(
        run, f"media_id {kind}, frame int, start_ms bigint, delay_ms bigint, width int, height int, disposal int, transparent int, rgba binary, hist_r array<bigint>, hist_g array<bigint>, hist_b array<bigint>, error string"
    )


def digests(media: DataFrame) -> DataFrame:
    """Per file: sizes and hashes of the stored bytes and of the samples read back, and a colour feature."""
    kind = media.schema["media_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, stored = [], batch.column(2).to_pylist()
            for i, got, error in _decoded(stored):
                if got is None:
                    raise ValueError(error or "no media")
                back, hist, ms = [], np.zeros(3 * HIST_BINS, np.int64), 0
                for f, when, shown, h in timed(*got):
                    back.append(shown[f.top : f.top + f.height, f.left : f.left + f.width, 0].tobytes())
                    hist += h
                    ms = when + f.delay_ms
                payload = b"".join(back)
                feature = f"{len(got[2])}f{ms}ms:" + ",".join(map(str, hist))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored[i]), hashlib.sha256(stored[i]).hexdigest(), feature))
            cols = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(cols, types)]], ["media_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("media_id", "n_bytes", "media").mapInArrow(
        run, f"media_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    )
