"""Media columns: byte payloads kept losslessly in baseline JPEGs, read back as DC-only luminance thumbnails.

Form. Each byte of the payload is the constant value of one 8x8 block of a greyscale image: with a DC step of 8 the
quantised DC coefficient is the byte less 128, all AC coefficients are 0, so the thumbnail of block means (an eighth of
the size) holds exactly the payload. Images are 24 * 8 pixels wide or a multiple of it, and a restart marker follows
every 576 blocks. A payload too long for one image's 65,535 rows and columns goes to several images, one after another.

Reading parses the markers, removes stuffed bytes, Huffman-decodes the scan and rebuilds the thumbnail in numpy. Restart
intervals of a batch are decoded side by side, LANES at a time, one table lookup a step; writing goes through as many units at a
time. So the arrays of numbers have a fixed size, and a long text takes memory of some six times its bytes. decode() reads any greyscale or
colour baseline JPEG of 8-bit samples with Huffman coding, sampling factors and AC coefficients included (which it skips).

Feature: width and height in pixels, the number of images and a difference hash of 64 bits of the thumbnail.

Defined cases: a null or empty text is stored as one unit of 576 bytes 255; equal texts give equal values, repeated rows
repeated results; a very long text is stored whole; an empty table gives an empty result; other columns are ignored; a
broken image raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerloom.llm._spark import batched
from layerloom.llm._stats import slices

UNIT, COLUMNS = 576, 24
MOST_BLOCKS = 65_535 // 8
#: Bytes of one image's thumbnail, at most.
MOST_BYTES = (MOST_BLOCKS // COLUMNS) * COLUMNS * (MOST_BLOCKS // COLUMNS) * COLUMNS
SLICE_BYTES = 2 << 20
#: Units that are written, or restart intervals that are read, side by side.
LANES = SLICE_BYTES // UNIT

# Huffman tables as (codes of each length 1..16, symbols). DC: a difference of s bits has a code of 9 - s bits.
DC_TABLE = ([1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], [8, 7, 6, 5, 4, 3, 2, 1, 0])
AC_TABLE = ([1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0], [0])

Table = tuple[list[int], list[int]]


def _codes(table: Table) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), as the standard assigns codes."""
    out, code, k = {}, 0, 0
    for length, count in enumerate(table[0], 1):
        for _ in range(count):
            out[table[1][k]] = (code, length)
            code += 1
            k += 1
        code <<= 1
    return out


@lru_cache(64)
def _lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits ahead: the symbol and the length of its code (0: no code)."""
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for s, (code, n) in _codes((list(counts), list(symbols))).items():
        at = code << (16 - n)
        symbol[at : at + (1 << (16 - n))], length[at : at + (1 << (16 - n))] = s, n
    return symbol, length


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(wide: int, high: int) -> bytes:
    """Everything before the scan of an image of wide x high blocks."""
    huffman = b"".join(bytes([kind, *t[0], *t[1]]) for kind, t in ((0x00, DC_TABLE), (0x10, AC_TABLE)))
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
            _segment(0xDB, bytes([0, 8] + [1] * 63)),
            _segment(0xC0, struct.pack(">BHHB3B", 8, high * 8, wide * 8, 1, 1, 0x11, 0)),
            _segment(0xC4, huffman),
            _segment(0xDD, struct.pack(">H", UNIT)),
            _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
        ]
    )


def _scans(samples: np.ndarray) -> list[bytes]:
    """The entropy-coded bytes of each unit of samples (n x UNIT), stuffed, without restart markers."""
    n = len(samples)
    values = samples.astype(np.int64) - 128
    diff = np.diff(values, axis=1, prepend=0)
    size = np.zeros(512, np.int64)
    for s in range(1, 9):
        size[1 << (s - 1) :] = s
    s = size[np.abs(diff)]
    codes = _codes(DC_TABLE)
    code, length = (np.array([codes[k][i] for k in range(9)]) for i in (0, 1))
    bits = np.where(diff < 0, diff + (1 << s) - 1, diff)
    eob, eob_length = _codes(AC_TABLE)[0]
    word = (((code[s] << s) | bits) << eob_length) | eob
    width = length[s] + s + eob_length
    ends = np.cumsum(width, axis=1)
    total = ends[:, -1]
    size_bytes = (total + 7) // 8
    most = int(size_bytes.max()) + 4
    start = ends - width
    four = word << (32 - (start & 7) - width)  # a code never reaches beyond the fourth byte from its first
    where = (start >> 3) + np.arange(n)[:, None] * most
    packed = np.zeros(n * most, np.int64)
    for k in range(4):
        part = (four >> (24 - 8 * k)) & 255
        if k < 2 or part.any():
            packed += np.bincount((where + k).ravel(), part.ravel(), n * most).astype(np.int64)
    packed = packed.reshape(n, most).astype(np.uint8)
    packed[np.arange(n), size_bytes - 1] |= ((1 << (-total % 8)) - 1).astype(np.uint8)  # unused bits are 1
    return [packed[i, : size_bytes[i]].tobytes().replace(b"\xff", b"\xff\0") for i in range(n)]


def shapes(size: int) -> list[tuple[int, int]]:
    """(wide, high) in blocks of the images that hold size bytes, a positive multiple of UNIT."""
    out = []
    while size > MOST_BYTES:
        out.append((MOST_BLOCKS // COLUMNS * COLUMNS, MOST_BLOCKS // COLUMNS * COLUMNS))
        size -= MOST_BYTES
    rows = size // COLUMNS
    times = 1
    while rows // times > MOST_BLOCKS or rows % times:
        times += 1
        if COLUMNS * times > MOST_BLOCKS:  # no such divisor: the larger part now, the rest in an image of its own
            part = MOST_BLOCKS // COLUMNS * COLUMNS * COLUMNS
            return [*out, (COLUMNS, part // COLUMNS), *shapes(size - part)]
    return [*out, (COLUMNS * times, rows // times)]


def payload(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % UNIT or UNIT * (not text))


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """Each payload, a positive multiple of UNIT bytes, as one or more JPEGs."""
    samples = np.frombuffer(payloads[0] if len(payloads) == 1 else b"".join(payloads), np.uint8).reshape(-1, UNIT)
    units = (x for k in range(0, len(samples), LANES) for x in _scans(samples[k : k + LANES]))
    out = []
    for p in payloads:
        images = []
        for wide, high in shapes(len(p)):
            count = wide * high // UNIT
            image = bytearray(_header(wide, high))
            for k in range(count):
                image += next(units)
                image += bytes([0xFF, 0xD0 + k % 8]) if k < count - 1 else b"\xff\xd9"
            images.append(image)
        out.append(bytes(images[0]) if len(images) == 1 else b"".join(images))
    return out


class Image:
    """A parsed image: size, components, tables and the intervals of its scan, unstuffed."""

    def __init__(self, data: bytes, at: int = 0):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no JPEG starts here")
        self.quant: dict[int, int] = {}
        self.huffman: dict[int, tuple[bytes, bytes]] = {}
        self.interval, self.parts, self.frame = 0, [], False
        at += 2
        while True:
            if at + 4 > len(data) or data[at] != 0xFF:
                raise ValueError("broken marker")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                self._quantisers(body)
            elif marker == 0xC0:
                depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if depth != 8 or not self.height or not self.width:
                    raise ValueError("only 8-bit samples and known sizes are read")
                self.parts = [tuple(body[6 + 3 * k : 9 + 3 * k]) for k in range(n)]
                self.frame = True
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only baseline images are read")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huffman[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                break
        if not self.frame or body[0] != len(self.parts):
            raise ValueError("the scan doesn't hold all components")
        self.tables = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
        self.intervals, self.end = _intervals(data, at)

    def _quantisers(self, body: bytes) -> None:
        while body:
            wide = body[0] >> 4
            self.quant[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
            body = body[1 + 64 * (1 + wide) :]

    def blocks(self) -> tuple[list[int], int, int]:
        """The component of each block of a MCU, and the MCUs across and down."""
        if len(self.parts) == 1:
            return [0], -(-self.width // 8), -(-self.height // 8)
        h, v = max(p[1] >> 4 for p in self.parts), max(p[1] & 15 for p in self.parts)
        order = [k for k, p in enumerate(self.parts) for _ in range((p[1] >> 4) * (p[1] & 15))]
        return order, -(-self.width // (8 * h)), -(-self.height // (8 * v))


def _intervals(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The scan's restart intervals without stuffing, and where the image ends."""
    out, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise ValueError("the scan has no end")
        follows = data[at + 1]
        if follows == 0:
            at += 2
        elif 0xD0 <= follows <= 0xD7:
            out.append(data[start:at].replace(b"\xff\0", b"\xff"))
            start = at = at + 2
        elif follows == 0xD9:
            out.append(data[start:at].replace(b"\xff\0", b"\xff"))
            return out, at + 2
        else:
            raise ValueError("a marker within the scan")


def _peek(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 16 bits from each bit position on; bits holds 24 bits from each byte on."""
    return (bits[at >> 3] >> (8 - (at & 7))) & 0xFFFF


def _dc_values(lanes: list[bytes], steps: list[tuple[int, tuple, tuple]], counts: np.ndarray) -> np.ndarray:
    """Quantised DC values (lanes x blocks) of intervals that share their tables; counts: the blocks in each.

    steps: for each block of a MCU its component and its DC and AC tables, which repeat until a lane's end.
    """
    joined = np.frombuffer(b"".join(x + b"\xff\xff\xff\xff" for x in lanes), np.uint8).astype(np.int64)
    bits = (joined[:-2] << 16) | (joined[1:-1] << 8) | joined[2:]
    sizes = np.array([len(x) for x in lanes], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 4)[:-1]]) * 8
    at, stop = begin.copy(), begin + sizes * 8
    out = np.zeros((int(counts.max()), len(lanes)), np.int64)
    last = np.zeros((max(s[0] for s in steps) + 1, len(lanes)), np.int64)
    lookups = [(c, _lookup(*dc), _lookup(*ac)) for c, dc, ac in steps]
    same = int(counts.min())
    everyone = np.arange(len(lanes))
    for k in range(len(out)):
        live = everyone if k < same else np.flatnonzero(counts > k)
        part, (dc, dc_length), (ac, ac_length) = lookups[k % len(lookups)]
        here = at[live]
        ahead = _peek(bits, here)
        s, n = dc[ahead], dc_length[ahead]
        if not n.all():
            raise ValueError("no such Huffman code")
        extra = _peek(bits, here + n) >> (16 - s)
        last[part, live] += np.where((extra << 1) >> s == 0, extra - (1 << s) + 1, extra)
        out[k, live] = last[part, live]
        here = here + n + s
        done, open_ = np.zeros(len(live), np.int64), np.arange(len(live))
        while len(open_):  # AC coefficients are skipped, 63 at most
            ahead = _peek(bits, here[open_])
            rs, n = ac[ahead], ac_length[ahead]
            if not n.all():
                raise ValueError("no such Huffman code")
            here[open_] += n + (rs & 15)
            done[open_] = np.where(rs == 0, 63, done[open_] + 1 + (rs >> 4))
            if (done > 63).any():
                raise ValueError("too many AC coefficients")
            open_ = open_[done[open_] < 63]
        if (here > stop[live]).any():
            raise ValueError("the scan ends too early")
        at[live] = here
    return out.T


def _all_images(data: bytes) -> list[Image]:
    out, at = [], 0
    while at < len(data):
        out.append(Image(data, at))
        at = out[-1].end
    return out


def thumbnails(images: list[Image]) -> list[np.ndarray]:
    """DC-only luminance of each image, one sample (0 to 255) a block; images with equal tables are decoded together."""
    groups: dict[tuple, list[int]] = {}
    for i, x in enumerate(images):
        order, _, _ = x.blocks()
        steps = tuple((c, x.huffman[t >> 4], x.huffman[16 + (t & 15)]) for c in order for t in [x.tables[x.parts[c][0]]])
        groups.setdefault(steps, []).append(i)
    out: list = [None] * len(images)
    for steps, members in groups.items():
        lanes, counts = [], []
        for i in members:
            _, across, down = images[i].blocks()
            left, each = across * down, images[i].interval or across * down
            if len(images[i].intervals) != -(-left // each):
                raise ValueError("a restart interval is missing")
            for lane in images[i].intervals:
                lanes.append(lane)
                counts.append(min(each, left) * len(steps))
                left -= each
        flat, at = np.empty(sum(counts), np.int16), 0  # a quantised DC value has 12 bits
        most = max(1, LANES * UNIT // max(counts))
        for low in range(0, len(lanes), most):
            few = np.array(counts[low : low + most])
            values = _dc_values(lanes[low : low + most], list(steps), few)
            if few.min() == few.max():
                flat[at : at + values.size] = values.ravel()
            else:
                flat[at : at + int(few.sum())] = values[np.arange(values.shape[1]) < few[:, None]]
            at += int(few.sum())
        at = 0
        for i in members:
            _, across, down = images[i].blocks()
            n = across * down * len(steps)
            out[i] = _luminance(images[i], flat[at : at + n].reshape(across * down, len(steps)), across, down)
            at += n
    return out


def _luminance(x: Image, flat: np.ndarray, across: int, down: int) -> np.ndarray:
    h, v = (1, 1) if len(x.parts) == 1 else (x.parts[0][1] >> 4, x.parts[0][1] & 15)
    grid = flat[:, : h * v].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    samples = np.empty(grid.shape, np.uint8)
    rows = max(1, SLICE_BYTES // grid.shape[1])
    for at in range(0, len(grid), rows):
        values = np.floor_divide(grid[at : at + rows].astype(np.int32) * x.quant[x.parts[0][2]] + 4, 8) + 128
        samples[at : at + rows] = np.clip(values, 0, 255)
    if len(x.parts) == 1:
        return samples
    high, wide = max(p[1] & 15 for p in x.parts), max(p[1] >> 4 for p in x.parts)
    return samples[: -(-x.height * v // (8 * high)), : -(-x.width * h // (8 * wide))]


def decode(data: bytes) -> list[np.ndarray]:
    """The thumbnails of the JPEGs in data, one after another."""
    return thumbnails(_all_images(data))


def difference_hash(thumbnail: np.ndarray) -> int:
    """64 bits: whether each of 8 x 9 sampled values is below its right neighbour."""
    rows = np.arange(8) * thumbnail.shape[0] // 8
    columns = np.arange(9) * thumbnail.shape[1] // 9
    small = thumbnail[np.ix_(rows, columns)].astype(np.int64)
    return int.from_bytes(np.packbits(small[:, :-1] < small[:, 1:]).tobytes(), "big")


SCHEMA = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, width bigint, height bigint"


def _store(keep_media: bool):
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                sizes = pc.binary_length(part.column("text")).fill_null(0).to_pylist()
                stored = encode_all([payload((t or "").encode()) for t in part.column("text").to_pylist()])
                images = [_all_images(m) for m in stored]
                found = iter(thumbnails([x for i in images for x in i]))
                rows = []
                for size, m, own in zip(sizes, stored, images, strict=True):
                    thumbs = [next(found) for _ in own]
                    back = thumbs[0].tobytes() if len(thumbs) == 1 else b"".join(x.tobytes() for x in thumbs)
                    hashed = "".join(f"{difference_hash(x):016x}" for x in thumbs)
                    feature = f"{own[0].width}x{own[0].height}x{len(own)}:{hashed}"
                    rows.append((size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature, own[0].width, own[0].height))
                columns = [part.column("id"), *([pa.array(stored, pa.binary())] if keep_media else [])]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                columns += [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                names = ["id", *(["media"] if keep_media else []), *[x.split()[0] for x in SCHEMA.split(", ")]]
                yield pa.RecordBatch.from_arrays(columns, names)

    return store


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """One row for each row of docs: id, the stored JPEGs (if keep_media), sizes, hashes and feature of what is read back."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return batched(rows, _store(keep_media), f"id {kind}, {'media binary, ' * keep_media}{SCHEMA}").withColumnRenamed("id", id_col)
