"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames, colour histograms.

`encode_gif` and `decode_gif` work on one file's bytes; `store_as_gif`, `gif_frames` and `gif_digests`
apply them to DataFrame columns, batch by batch, without a shuffle.

Defined results: a null text or payload counts as empty; a null or broken GIF, or one of more than
PIXELS pixels, gives a row with `error` set and no frame, after the frames before the fault; equal payloads give equal files; columns that the caller keeps pass through
under their own names. A frame that an empty file lacks is no row.
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

from .common import batch_of, steps, texts

GRAY = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))
WIDTH, ROWS = 64, 4096
BINS = 16
#: Pixels of a canvas or a frame, at most: 64 MB of RGBA.
PIXELS = 1 << 24


class GifError(ValueError):
    """The bytes are no GIF that the format's rules allow."""


@dataclass
class Frame:
    indices: np.ndarray  # rows x columns of palette places
    palette: bytes
    left: int = 0
    top: int = 0
    delay_ms: int = 0
    disposal: int = 0
    transparent: int | None = None


def _plan(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Width and first bit of the codes after a clear code: the table grows by one with each code but the first."""
    first = (1 << bits) + 2
    size = np.maximum(first, first - 1 + np.arange(2 * 4096))
    width = np.clip(np.floor(np.log2(size)).astype(np.int64) + 1, bits + 1, 12)
    return width, np.concatenate([[0], np.cumsum(width)])


_PLANS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def plan(bits: int) -> tuple[np.ndarray, np.ndarray]:
    if bits not in _PLANS:
        _PLANS[bits] = _plan(bits)
    return _PLANS[bits]


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """The samples as one code stream; the table is cleared whenever it is full."""
    clear, stop = 1 << bits, (1 << bits) + 1
    width, _ = plan(bits)
    runs: list[list[int]] = []
    rest = iter(samples)
    prefix = next(rest, None)
    known: dict[int, int] = {}
    codes, free = [], stop + 1
    get, put = known.get, codes.append
    for sample in rest:
        key = prefix << 8 | sample
        longer = get(key)
        if longer is not None:
            prefix = longer
            continue
        put(prefix)
        known[key] = free
        free += 1
        prefix = sample
        if free == 4096:
            runs.append([*codes, clear])
            codes, known, free = [], {}, stop + 1
            get, put = known.get, codes.append
    runs.append([*codes, *([] if prefix is None else [prefix]), stop])
    out = [_bits(np.array([clear]), bits + 1)]
    stretches = [(w, *np.flatnonzero(width == w)[[0, -1]]) for w in range(bits + 1, 13)]
    for run in runs:
        values = np.array(run, "<u2")
        out += [_bits(values[first : last + 1], w) for w, first, last in stretches if first < len(values)]
    return np.packbits(np.concatenate(out), bitorder="little").tobytes()


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    return np.unpackbits(values.astype("<u2").view(np.uint8), bitorder="little").reshape(-1, 16)[:, :width].ravel()


def lzw_decode(stream: bytes, bits: int, count: int) -> bytes:
    """The first `count` samples of a code stream; fewer if it ends early. A full table without a clear code stays as it
    is, and codes stay 12 bits wide, for as long as the stream goes on."""
    if not 1 <= bits <= 8:
        raise GifError(f"minimum code size {bits}")
    clear, stop = 1 << bits, (1 << bits) + 1
    width, begin = plan(bits)
    late = 12 * np.arange(len(width) + 1)
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    total, at, made = len(stream) * 8, 0, 0
    out: list[bytes] = []
    while made < count:
        run, last = [], None
        while last is None:
            starts, wide = (late, 12) if run else (begin, width)
            n = min(len(width), int(np.searchsorted(starts, total - at, "right")) - 1)
            if n <= 0:
                break
            bit = starts[:n] + at
            place = bit >> 3
            codes = (raw[place] | raw[place + 1] << 8 | raw[place + 2] << 16) >> (bit & 7) & ((1 << (wide if run else wide[:n])) - 1)
            ends = np.flatnonzero((codes == clear) | (codes == stop))
            if len(ends):
                last = int(codes[ends[0]])
                codes, n = codes[: ends[0]], int(ends[0]) + 1
            run.append(codes)
            at += int(starts[n])
        codes = np.concatenate([*run, np.zeros(0, np.int64)])
        if len(codes):
            out.append(_expand(codes, stop + 1))
            made += len(out[-1])
        if last != clear:
            break
    return b"".join(out)[:count]


def _expand(codes: np.ndarray, first: int) -> bytes:
    """The samples of the codes after a clear code. The entry that the code at i made is what i put out and
    the sample after it, so each later sample is a copy of an earlier one: the copies are followed to their
    literals by doubling."""
    n = len(codes)
    entry = codes - first
    if np.any(entry >= np.minimum(np.arange(n), 4096 - first)):
        raise GifError("a code stands for nothing yet")
    literal = entry < 0
    size, up = np.ones(n, np.int64), np.where(literal, -1, entry)
    while np.any(more := up >= 0):
        size[more] += size[up[more]]
        up[more] = up[up[more]]
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.arange(begin[-1])
    out += np.repeat(np.where(literal, 0, begin[np.maximum(entry, 0)] - begin[:-1]), size)
    while True:
        further = out[out]
        if np.array_equal(further, out):
            break
        out = further
    samples = np.zeros(begin[-1], np.uint8)
    samples[begin[:-1][literal]] = codes[literal]
    return samples[out].tobytes()


def encode_gif(frames: list[Frame], width: int, height: int, loop: int | None = None) -> bytes:
    """A GIF89a file with the first frame's palette as the global one."""
    palette = frames[0].palette if frames else GRAY
    depth = max(1, (len(palette) // 3 - 1).bit_length())
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x80 | 0x70 | depth - 1, 0, 0), palette.ljust(3 << depth, b"\0")]
    if loop is not None:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", loop) + b"\0")
    for f in frames:
        flags = f.disposal << 2 | (f.transparent is not None)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", flags, f.delay_ms // 10, f.transparent or 0) + b"\0")
        rows, columns = f.indices.shape
        own = f.palette != palette
        local = max(1, (len(f.palette) // 3 - 1).bit_length())
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, columns, rows, 0x80 | local - 1 if own else 0))
        if own:
            out.append(f.palette.ljust(3 << local, b"\0"))
        bits = max(2, local if own else depth)
        stream = lzw_encode(f.indices.tobytes(), bits)
        out.append(bytes([bits]))
        out += [bytes([len(part)]) + part for part in (stream[i : i + 255] for i in range(0, len(stream), 255))]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        size = data[at]
        if not size:
            return b"".join(parts), at + 1
        part = data[at + 1 : at + 1 + size]
        if len(part) < size:
            raise GifError("a block is cut off")
        parts.append(part)
        at += 1 + size


def decode_gif(data: bytes, pixels: int = PIXELS) -> tuple[int, int, Iterator[Frame]]:
    """Width and height of the canvas, and its frames as they are stored (rows put in order if interlaced). A canvas or frame
    of over `pixels` pixels, a code stream that ends early, and a minimum code size that GIF does not have are a GifError."""
    if len(data) < 13 or data[:6] not in (b"GIF87a", b"GIF89a"):
        raise GifError("no GIF signature")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > pixels:
        raise GifError(f"a canvas of {width} x {height}")
    return width, height, _frames(data, flags, pixels)


def _frames(data: bytes, flags: int, pixels: int) -> Iterator[Frame]:
    at, shared = 13, GRAY
    if flags & 0x80:
        shared, at = data[at : at + (6 << (flags & 7))], at + (6 << (flags & 7))
    delay, disposal, transparent = 0, 0, None
    try:
        while data[at] != 0x3B:
            if data[at] == 0x21:
                label = data[at + 1]
                body, at = _blocks(data, at + 2)
                if label == 0xF9 and len(body) >= 4:
                    packed, ticks, place = struct.unpack_from("<BHB", body)
                    delay, disposal, transparent = ticks * 10, packed >> 2 & 7, place if packed & 1 else None
            elif data[at] == 0x2C:
                left, top, columns, rows, packed = struct.unpack_from("<HHHHB", data, at + 1)
                if rows * columns > pixels:
                    raise GifError(f"a frame of {columns} x {rows}")
                at, palette = at + 10, shared
                if packed & 0x80:
                    palette, at = data[at : at + (6 << (packed & 7))], at + (6 << (packed & 7))
                bits = data[at]
                stream, at = _blocks(data, at + 1)
                samples = lzw_decode(stream, bits, rows * columns)
                if len(samples) < rows * columns:
                    raise GifError("a code stream ends early")
                indices = np.frombuffer(samples, np.uint8).reshape(rows, columns)
                if packed & 0x40:
                    order = [*range(0, rows, 8), *range(4, rows, 8), *range(2, rows, 4), *range(1, rows, 2)]
                    indices = indices[np.argsort(order)]
                yield Frame(indices, palette, left, top, delay, disposal, transparent)
                delay, disposal, transparent = 0, 0, None
            else:
                raise GifError(f"block {data[at]:#x}")
    except (IndexError, struct.error) as e:
        raise GifError("the file is cut off") from e


def composite(width: int, height: int, frames: Iterator[Frame]) -> Iterator[tuple[Frame, np.ndarray]]:
    """Each frame with the RGBA canvas as it is shown; the canvas is the reader's until the next frame."""
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        rows, columns = min(f.indices.shape[0], max(0, height - f.top)), min(f.indices.shape[1], max(0, width - f.left))
        table = np.zeros((256, 4), np.uint8)
        colours = np.frombuffer(f.palette, np.uint8)[: len(f.palette) // 3 * 3].reshape(-1, 3)
        table[: len(colours), :3] = colours
        table[:, 3] = 255
        spot, own = canvas[f.top : f.top + rows, f.left : f.left + columns], f.indices[:rows, :columns]
        if f.transparent is None:
            spot[...] = table[own]
        else:
            seen = own != f.transparent
            spot[seen] = table[own[seen]]
        yield f, canvas
        if f.disposal == 2:
            spot[...] = 0
        elif before is not None:
            canvas = before


def histogram(pixels: np.ndarray, bins: int = BINS) -> list[list[int]]:
    """Counts of each channel's values, in `bins` equal ranges, over the pixels that are not clear."""
    seen = pixels.reshape(-1, 4)
    seen = seen[seen[:, 3] > 0]
    return [np.bincount(seen[:, c] // (256 // bins), minlength=bins).tolist() for c in range(3)]


def payload_gif(payload: bytes) -> bytes:
    """A payload of a positive multiple of 64 bytes as gray samples, in frames of 64 columns that are shown in turn."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    parts = [rows[i : i + ROWS] for i in range(0, len(rows), ROWS)]
    return encode_gif([Frame(p, GRAY, delay_ms=40, disposal=1) for p in parts], WIDTH, len(parts[0]), loop=0 if len(parts) > 1 else None)


def store_as_gif(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each text's UTF-8 bytes, zeros appended up to a positive multiple of 64, as a GIF."""

    def run(batches):
        for batch in batches:
            for part in steps(batch, text, 1 << 20):
                raw = [x.as_buffer().to_pybytes() for x in texts(part, text)]
                media = [payload_gif(x.ljust(max(64, -len(x) % 64 + len(x)), b"\0")) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, media binary")


def gif_frames(df: DataFrame, key: str = "doc_id", media: str = "media", pixels: int = PIXELS) -> DataFrame:
    """One row per frame: its place in time, rectangle, rules, shown RGBA canvas and colour histograms. A file that is no GIF, is
    cut off, or is larger than `pixels` has, after the frames before the fault, a row with the `error`."""

    def rows(item, data):
        shown = 0
        try:
            if data is None:
                raise GifError("no bytes")
            width, height, frames = decode_gif(data, pixels)
            for n, (f, canvas) in enumerate(composite(width, height, frames)):
                red, green, blue = histogram(canvas)
                yield item, n, shown, f.delay_ms, f.disposal, f.transparent, width, height, f.left, f.top, f.indices.shape[1], f.indices.shape[0], canvas.tobytes(), red, green, blue, None
                shown += f.delay_ms
        except GifError as e:
            yield (item, *[None] * 15, str(e))

    kind = df.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {kind}, frame int, at_ms int, delay_ms int, disposal int, transparent int, canvas_width int, canvas_height int,"
        " left int, top int, width int, height int, rgba binary, hist_red array<bigint>, hist_green array<bigint>, hist_blue array<bigint>, error string"
    )
    names = [x.strip().split(" ")[0].strip("`") for x in schema.split(",")]

    def run(batches):
        kinds = [None, *[pa.int32()] * 11, pa.binary(), *[pa.list_(pa.int64())] * 3, pa.string()]
        for batch in batches:
            kinds[0] = batch.column(0).type
            for i in range(batch.num_rows):
                for row in rows(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

    return df.select(key, media).mapInArrow(run, schema)


def gif_digests(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """What a payload's GIF holds, read from its stored bytes: every frame is decoded, coloured and composed first."""

    def read(data: bytes):
        width, height, frames = decode_gif(data)
        counts, digest, size, tail, n, time = np.zeros(BINS, np.int64), hashlib.sha256(), 0, b"", 0, 0
        for f, canvas in composite(width, height, frames):
            rows, columns = f.indices.shape
            pixels = canvas[f.top : f.top + rows, f.left : f.left + columns]
            samples = pixels[..., 0].tobytes()
            counts += np.bincount(np.frombuffer(samples, np.uint8), minlength=256).reshape(BINS, -1).sum(axis=1)
            digest.update(samples)
            size, tail, n, time = size + len(samples), samples[-64:], n + 1, time + f.delay_ms
        return size, digest.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), f"{n} frames, {time} ms, {width}x{height}: " + " ".join(map(str, counts))

    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            found = list(zip(*(read(x.as_py()) for x in batch.column(2)), strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, t) for v, t in zip(found, kinds, strict=True))], names=names)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "n_bytes", media).mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def op1_media(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return gif_digests(store_as_gif(table(spark, sf_dir, "documents")))
