"""Progressive JPEG media columns (operator 2).

``encode_payloads`` stores bytes losslessly as the coefficients of a progressive 4:2:0 JPEG;
``decode_media`` reads any 8-bit Huffman-coded progressive JPEG: it accumulates the spectral-selection
and successive-approximation scans into coefficient arrays, inverse-transforms them in numpy,
upsamples chroma and returns full-resolution RGB tensors.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import byte_batches, text_or_empty
from tidewell.operators.sizes import spread

BLOCK = 64
#: Bytes of media that a worker decodes before it hands results on.
MEDIA_BYTES = 1 << 20
#: Most MCUs a side of the grid that holds a payload.
MOST_SIDE = 4095
#: Blocks that are inverse-transformed at once.
BLOCKS_AT_ONCE = 1 << 14

_u, _x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
_basis = np.cos((2 * _x + 1) * _u * np.pi / 16) * np.where(_u == 0, np.sqrt(1 / 8), 0.5)


def _zigzag() -> np.ndarray:
    """Natural index of each zigzag position: anti-diagonals, direction alternating."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()
#: (64 zigzag coefficients) @ INVERSE = 64 samples, row by row.
INVERSE = np.einsum("ux,vy->uvxy", _basis, _basis).reshape(64, 64)[ZIGZAG].astype(np.float32)


# ---------------------------------------------------------------- writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, number: int, lengths: dict[int, list[int]]) -> bytes:
    """A Huffman table segment from the symbols of each code length."""
    return _segment(0xC4, bytes([kind << 4 | number]) + bytes(len(lengths.get(n, [])) for n in range(1, 17)) + bytes(s for n in sorted(lengths) for s in lengths[n]))


def _scan(parts: list[tuple[int, int, int]], ss: int, se: int, ah: int, al: int, bits: bytes) -> bytes:
    head = bytes([len(parts)]) + b"".join(bytes([c, dc << 4 | ac]) for c, dc, ac in parts) + bytes([ss, se, ah << 4 | al])
    return _segment(0xDA, head) + bits.replace(b"\xff", b"\xff\x00")


def _packed(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of the given widths one after the other, filled up with ones."""
    ends = np.cumsum(widths)
    total = int(ends[-1])
    place = np.repeat(ends, widths) - 1 - np.arange(total)
    bits = (np.repeat(values, widths) >> place) & 1
    return np.packbits(np.concatenate([bits.astype(np.uint8), np.ones(-total % 8, np.uint8)])).tobytes()


_TABLES = _table(0, 0, {4: list(range(9))}) + _table(1, 0, {1: [7]}) + _table(1, 1, {1: [0]})
_QUANT = _segment(0xDB, bytes([0]) + bytes([1]) * 64)


def encode_payload(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload, a positive multiple of 64 bytes: one block for each 64.

    Byte ``b`` becomes the coefficient of magnitude category 8 whose extra bits are ``b``: ``b`` from 128
    on, ``b - 255`` below.  The first scans leave out the lowest bit, so an AC coefficient takes one code
    bit and seven more; refinement scans add the lowest bits.
    """
    if not payload or len(payload) % BLOCK:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    mcus = -(-len(payload) // (6 * BLOCK))
    wide = -(-mcus // MOST_SIDE)
    high = -(-mcus // wide)
    data = np.frombuffer(payload.ljust(wide * high * 6 * BLOCK, b"\0"), np.uint8).reshape(high, wide, 6, BLOCK)
    low = (data & 1) ^ (data < 128)  # lowest bit of the magnitude
    luma = lambda a: a[:, :, :4].reshape(high, wide, 2, 2, BLOCK).transpose(0, 2, 1, 3, 4).reshape(-1, BLOCK)
    planes = [(luma(data), luma(low)), *((data[:, :, k].reshape(-1, BLOCK), low[:, :, k].reshape(-1, BLOCK)) for k in (4, 5))]

    dc = data[..., 0].astype(np.int32).reshape(-1, 6)
    dc = np.where(dc >= 128, dc, dc - 255)
    half, bit = dc >> 1, (dc & 1).astype(np.uint8)
    diff = np.empty_like(half)
    diff[:, :4].flat = np.diff(half[:, :4].ravel(), prepend=0)
    diff[:, 4:] = np.diff(half[:, 4:], axis=0, prepend=0)
    diff = diff.ravel()
    width = np.ceil(np.log2(np.abs(diff) + 1)).astype(np.int32)
    extra = np.where(diff < 0, diff + (1 << width) - 1, diff)
    first_dc = _packed(width << width | extra, width + 4)

    refine = [np.packbits(np.concatenate([np.zeros((len(lo), 1), np.uint8), lo[:, 1:]], axis=1)).tobytes() for _, lo in planes]
    ids = (1, 2, 3)
    return b"".join([
        b"\xff\xd8", _segment(0xFE, b"payload=%d" % len(payload)), _QUANT,
        _segment(0xC2, struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), _TABLES,
        _scan([(c, 0, 0) for c in ids], 0, 0, 0, 1, first_dc),
        _scan([(1, 0, 0)], 1, 5, 0, 1, (planes[0][0][:, 1:6] >> 1).tobytes()),
        *(_scan([(c, 0, 0)], 1, 63, 0, 1, (planes[c - 1][0][:, 1:] >> 1).tobytes()) for c in (2, 3)),
        _scan([(1, 0, 0)], 6, 63, 0, 1, (planes[0][0][:, 6:] >> 1).tobytes()),
        _scan([(c, 0, 0) for c in ids], 0, 0, 1, 0, np.packbits(np.concatenate([bit.ravel(), np.ones(-bit.size % 8, np.uint8)])).tobytes()),
        *(_scan([(c, 0, 1)], 1, 63, 1, 0, refine[c - 1]) for c in ids),
        b"\xff\xd9"])


# ---------------------------------------------------------------- reading


@dataclass
class Component:
    number: int
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks, filled up to whole MCUs
    high: int = 0
    own_wide: int = 0  # blocks that cover the component
    own_high: int = 0
    coefs: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Image:
    height: int = 0
    width: int = 0
    components: list[Component] = field(default_factory=list)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""


@dataclass
class Huffman:
    symbols: list[int]  # by 16-bit prefix; -1: no code
    widths: list[int]
    only: int | None  # the symbol, if there is one alone, of one bit


class Bits:
    """A bit reader with the 16 bits from each place on at hand."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        padded = np.concatenate([np.frombuffer(data, np.uint8), np.full(4, 255, np.uint8)]).astype(np.uint32)
        word = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
        self.ahead = ((word[:, None] >> np.arange(16, 8, -1, dtype=np.uint32)) & 0xFFFF).ravel().tolist()
        self.at = 0

    def symbol(self, table: Huffman) -> int:
        prefix = self.ahead[self.at]
        found = table.symbols[prefix]
        if found < 0:
            raise ValueError("no such code")
        self.at += table.widths[prefix]
        return found

    def take(self, n: int) -> int:
        if not n:
            return 0
        x = self.ahead[self.at] >> (16 - n)
        self.at += n
        return x


def _huffman(counts: bytes, symbols: bytes) -> Huffman:
    by_prefix, widths = [-1] * 65536, [0] * 65536
    code = k = 0
    for width in range(1, 17):
        for _ in range(counts[width - 1]):
            span = 1 << (16 - width)
            by_prefix[code * span:(code + 1) * span] = [symbols[k]] * span
            widths[code * span:(code + 1) * span] = [width] * span
            code += 1
            k += 1
        code <<= 1
    return Huffman(by_prefix, widths, symbols[0] if k == 1 and counts[0] == 1 else None)


def _signed(x: int, width: int) -> int:
    return x if not width or x >> (width - 1) else x - (1 << width) + 1


_tables_seen: dict[bytes, Huffman] = {}


def read_coefficients(data: bytes) -> Image:
    """All scans of a progressive JPEG, accumulated; coefficients in zigzag order, not yet multiplied by the quantisation tables."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    image, tables, restart, at = Image(), {}, 0, 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker was expected")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4:at + 2 + size], at + 2 + size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                image.quants[body[0] & 15] = np.frombuffer(body[1:1 + 64 * wide], ">u2" if wide == 2 else "u1").astype(np.int32)
                body = body[1 + 64 * wide:]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                key = body[1:17 + n]
                if key not in _tables_seen:
                    if len(_tables_seen) > 64:
                        _tables_seen.clear()
                    _tables_seen[key] = _huffman(key[:16], key[16:])
                tables[body[0] >> 4, body[0] & 15] = _tables_seen[key]
                body = body[17 + n:]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            _frame(image, body)
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a progressive Huffman-coded JPEG")
        elif marker == 0xDA:
            end = at
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    end = len(data)
                    break
                if data[end + 1] and not 0xD0 <= data[end + 1] <= 0xD7:
                    break
                end += 2
            _read_scan(image, body, data[at:end], tables, restart)
            at = end
    if not image.components:
        raise ValueError("no frame")
    return image


def _frame(image: Image, body: bytes) -> None:
    depth, image.height, image.width, n = struct.unpack_from(">BHHB", body)
    if depth != 8 or not image.height or not image.width or n not in (1, 3):
        raise ValueError("8-bit images of one or three components are read")
    image.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
    hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
    across, down = -(-image.width // (8 * hm)), -(-image.height // (8 * vm))
    for c in image.components:
        c.wide, c.high = across * c.h, down * c.v
        c.own_wide, c.own_high = -(-(-(-image.width * c.h // hm)) // 8), -(-(-(-image.height * c.v // vm)) // 8)
        c.coefs = np.zeros((c.wide * c.high, 64), np.int32)


def _read_scan(image: Image, head: bytes, entropy: bytes, tables: dict, restart: int) -> None:
    n = head[0]
    parts = [(next(c for c in image.components if c.number == head[1 + 2 * i]), head[2 + 2 * i] >> 4, head[2 + 2 * i] & 15) for i in range(n)]
    ss, se, ah, al = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
    if n > 1:  # interleaved: MCU by MCU
        c0 = parts[0][0]
        order = [np.add.outer(np.arange(c.high // c.v) * c.v * c.wide, np.arange(c.wide // c.h) * c.h).reshape(-1, 1)
                 + np.add.outer(np.arange(c.v) * c.wide, np.arange(c.h)).reshape(1, -1) for c, _, _ in parts]
        units = (c0.wide // c0.h) * (c0.high // c0.v)
    else:
        c = parts[0][0]
        order = [np.add.outer(np.arange(c.own_high) * c.wide, np.arange(c.own_wide)).reshape(-1, 1)]
        units = c.own_high * c.own_wide
    runs = re.split(rb"\xff[\xd0-\xd7]", entropy) if restart else [entropy]
    each = restart or units
    for k, run in enumerate(runs):
        blocks = [o[k * each:(k + 1) * each] for o in order]
        if not len(blocks[0]):
            break
        run = run.replace(b"\xff\x00", b"\xff")
        if ss == 0:
            if se:
                raise ValueError("a progressive scan holds DC or AC coefficients")
            (_dc_refine if ah else _dc_first)(parts, blocks, run, tables, al)
        else:
            (_ac_refine if ah else _ac_first)(parts[0][0], blocks[0].ravel(), run, tables[1, parts[0][2]], ss, se, al)


def _dc_first(parts, blocks, run, tables, al) -> None:
    bits = Bits(run)
    ahead, at = bits.ahead, 0
    plan = [(tables[0, dc], b.shape[1]) for (_, dc, _), b in zip(parts, blocks, strict=True)]
    last, got = [0] * len(plan), [[] for _ in plan]
    for _ in range(len(blocks[0])):
        for i, (table, each) in enumerate(plan):
            for _ in range(each):
                prefix = ahead[at]
                width = table.symbols[prefix]
                at += table.widths[prefix]
                if width > 0:
                    x = ahead[at] >> (16 - width)
                    at += width
                    last[i] += x if x >> (width - 1) else x - (1 << width) + 1
                elif width < 0:
                    raise ValueError("no such code")
                got[i].append(last[i])
    for (c, _, _), b, values in zip(parts, blocks, got, strict=True):
        c.coefs[b.ravel(), 0] = np.array(values, np.int32) << al


def _dc_refine(parts, blocks, run, tables, al) -> None:
    bits = np.unpackbits(np.frombuffer(run, np.uint8))
    sizes = [b.shape[1] for b in blocks]
    bits = bits[:len(blocks[0]) * sum(sizes)].reshape(len(blocks[0]), -1).astype(np.int32)
    start = 0
    for (c, _, _), b, n in zip(parts, blocks, sizes, strict=True):
        c.coefs[b.ravel(), 0] |= bits[:, start:start + n].ravel() << al
        start += n


def _ac_first(c, blocks, run, table, ss, se, al) -> None:
    n = se - ss + 1
    if table.only is not None and 0 < table.only < 16:
        # one symbol alone, no zeros between: all coefficients are equally wide
        width = table.only + 1
        bits = np.unpackbits(np.frombuffer(run, np.uint8), count=len(blocks) * n * width) if width != 8 else None
        raw = np.frombuffer(run, np.uint8, len(blocks) * n).astype(np.int32) if bits is None else bits.reshape(-1, width)[:, 1:] @ (1 << np.arange(width - 2, -1, -1, dtype=np.int32))
        s = table.only
        value = np.where(raw >> (s - 1), raw, raw - (1 << s) + 1) * (1 << al)
        c.coefs[blocks, ss:se + 1] = value.reshape(len(blocks), n)
        return
    bits, skip = Bits(run), 0
    for b in blocks.tolist():
        if skip:
            skip -= 1
            continue
        k, row = ss, c.coefs[b]
        while k <= se:
            r, s = divmod(bits.symbol(table), 16)
            if s:
                k += r
                row[k] = _signed(bits.take(s), s) * (1 << al)
                k += 1
            elif r == 15:
                k += 16
            else:
                skip = (1 << r) - 1 + bits.take(r)
                break


def _ac_refine(c, blocks, run, table, ss, se, al) -> None:
    n = se - ss + 1
    if table.only == 0:
        # one symbol alone, "end of block": every block has a code bit and a bit for each coefficient that isn't 0
        part = c.coefs[blocks, ss:se + 1]
        seen = part != 0
        if seen.all():
            more = np.unpackbits(np.frombuffer(run, np.uint8), count=len(blocks) * (n + 1)).reshape(len(blocks), n + 1)[:, 1:]
            c.coefs[blocks, ss:se + 1] = part + np.where(part > 0, 1 << al, -(1 << al)) * more
            return
    bits, skip, one = Bits(run), 0, 1 << al

    def correct(row, k) -> None:
        if bits.take(1) and not abs(row[k]) & one:
            row[k] += one if row[k] > 0 else -one

    for b in blocks.tolist():
        k, row = ss, c.coefs[b]
        while k <= se and not skip:
            r, s = divmod(bits.symbol(table), 16)
            if s == 0 and r < 15:
                skip = (1 << r) + bits.take(r)
                break
            new = 0 if s == 0 else one if bits.take(1) else -one
            while k <= se:
                if row[k]:
                    correct(row, k)
                elif r == 0:
                    row[k] = new
                    k += 1
                    break
                else:
                    r -= 1
                k += 1
        if skip:
            for k in range(k, se + 1):
                if row[k]:
                    correct(row, k)
            skip -= 1


def to_rgb(image: Image) -> np.ndarray:
    """Height x width x 3 samples: inverse transform, chroma repeated up to full resolution, colours converted."""
    hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        quant = image.quants[c.quant].astype(np.float32)
        samples = np.empty((len(c.coefs), 64), np.uint8)
        for start in range(0, len(c.coefs), BLOCKS_AT_ONCE):
            part = (c.coefs[start:start + BLOCKS_AT_ONCE] * quant) @ INVERSE
            samples[start:start + BLOCKS_AT_ONCE] = np.clip(np.rint(part + 128), 0, 255)
        plane = samples.reshape(c.high, c.wide, 8, 8).swapaxes(1, 2).reshape(c.high * 8, c.wide * 8)
        if c.v != vm or c.h != hm:
            rows, cols = np.arange(image.height) * c.v // vm, np.arange(image.width) * c.h // hm
            plane = plane[rows[:, None], cols[None, :]] if vm % c.v or hm % c.h else plane.repeat(vm // c.v, 0).repeat(hm // c.h, 1)
        planes.append(plane[:image.height, :image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2)
    y, cb, cr = planes[0].astype(np.float32), planes[1].astype(np.float32) - 128, planes[2].astype(np.float32) - 128
    out = np.empty((image.height, image.width, 3), np.uint8)
    for k, x in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
        out[:, :, k] = np.clip(np.rint(x), 0, 255)
    return out


def payload_of(image: Image) -> bytes | None:
    """The bytes that ``encode_payload`` stored, from the coefficients; None for other images."""
    found = re.fullmatch(rb"payload=(\d+)", image.comment)
    if not found or len(image.components) != 3:
        return None
    y, cb, cr = (c.coefs for c in image.components)
    high, wide = image.components[1].high, image.components[1].wide
    data = np.empty((high, wide, 6, BLOCK), np.int32)
    data[:, :, :4] = y.reshape(high, 2, wide, 2, BLOCK).transpose(0, 2, 1, 3, 4).reshape(high, wide, 4, BLOCK)
    data[:, :, 4], data[:, :, 5] = cb.reshape(high, wide, BLOCK), cr.reshape(high, wide, BLOCK)
    return np.where(data < 0, data + 255, data).astype(np.uint8).tobytes()[:int(found[1])]


# ---------------------------------------------------------------- columns


def encode_payloads(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, n_bytes, media)``: each whole text's UTF-8, filled up with 0 to a positive multiple of 64, as a progressive JPEG.

    Null and empty texts become a block of zeros.  Repeated rows give repeated results, a null id stays
    null, an empty table gives no rows, other columns are ignored.  No shuffle; batches by bytes.
    """
    source = spread(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text", MEDIA_BYTES):
            raw = [t.encode() for t in batch.column("text").to_pylist()]
            media = [encode_payload(t + bytes(-len(t) % BLOCK or (0 if t else BLOCK))) for t in raw]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    return source.mapInArrow(run, f"id {id_type}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def decode_media(media: DataFrame, *, media_col: str = "media") -> DataFrame:
    """``media`` with ``payload, height, width, rgb, rgb_sums, error`` (replacing columns of these names).

    ``rgb`` is the full-resolution tensor, row by row, as bytes; ``rgb_sums`` the exact sums of its
    channels; ``payload`` what ``encode_payload`` stored, null for other images.  Null media gives
    nulls; what can't be read gives nulls and a reason in ``error``.  All rows stay.
    """
    new = ("payload", "height", "width", "rgb", "rgb_sums", "error")
    source = media.drop(*new)
    kept = source.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema), "payload binary, height int, width int, rgb binary, rgb_sums array<long>, error string"])

    def read(data: bytes | None):
        if data is None:
            return (None,) * 6
        try:
            image = read_coefficients(data)
            rgb = to_rgb(image)
        except (ValueError, IndexError, KeyError, StopIteration, struct.error) as e:
            return None, None, None, None, None, f"{type(e).__name__}: {e}"
        return payload_of(image), image.height, image.width, rgb.tobytes(), rgb.sum((0, 1), dtype=np.int64).tolist(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]
        for batch in byte_batches(batches, media_col, MEDIA_BYTES):
            rows = list(zip(*map(read, batch.column(media_col).to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(v, t) for v, t in zip(rows, types, strict=True))], names=[*kept, *new])

    return source.mapInArrow(run, schema)
