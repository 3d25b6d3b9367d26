"""Media columns of progressive JPEG.

The decoder takes any Huffman-coded progressive JPEG (SOF2) of 8 bits and one or three components: it accumulates all
scans, of any spectral selection and successive approximation, into arrays of coefficients, transforms them back with
one matrix product, repeats chroma samples to full resolution and gives an RGB tensor. Where a scan has codes of one
length in a row (a DC run of zeros, whole blocks without zeros, the correction bits under an end-of-band run), it is
read by array operations, else code by code.

Bytes are stored losslessly in the unit of the format, quantized coefficients: byte b is an AC coefficient of magnitude
128 + b % 128, negative from 128 on, 63 to a block, in three components with chroma at half resolution. Its seven high
bits go in first scans (luma bands 1-5 and 6-63, chroma 1-63), the low bit in refinement scans. Coefficients beyond the
payload are as for byte 255; a comment segment holds the lengths.

Defined cases: a null or empty text is a payload of 576 bytes of 255; texts of any length are stored whole; rows that
repeat give equal rows; a null id is kept; further columns are ignored; an empty table gives no rows; a damaged image
raises ValueError.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftarc.llm.common import arrow, slices, stored

UNIT = 576  # payloads are a multiple of it
PER_MCU = 6 * 63  # of 4:2:0: four blocks of luma, two of chroma
LONGEST_RUN = 32767


def _zigzag() -> np.ndarray:
    """Place in the zigzag of each (row, column), by anti-diagonals of alternating direction."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in order])


def _basis() -> np.ndarray:
    """64 coefficients in zigzag order to 64 samples in row order."""
    u = np.arange(8)
    c = np.where(u == 0, np.sqrt(0.125), 0.5)[:, None] * np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16)
    return np.kron(c, c)[_zigzag()].astype(np.float32)


ZIGZAG, BASIS = _zigzag(), _basis()


# encoding


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, place: int, by_length: dict[int, bytes]) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | place]) + bytes(len(by_length.get(n, b"")) for n in range(1, 17)) + b"".join(by_length[n] for n in sorted(by_length)))


def _scan(components: list[int], first: int, last: int, high: int, low: int, table: int, data: bytes) -> bytes:
    head = bytes([len(components)]) + b"".join(bytes([c, table]) for c in components) + bytes([first, last, high << 4 | low])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def _packed(bits: np.ndarray) -> bytes:
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


def _refinement(low: np.ndarray) -> bytes:
    """Correction bits (blocks, 63), each run of blocks under one end-of-band code of four bits and its extra bits."""
    parts = []
    for i in range(0, len(low), LONGEST_RUN):
        part = low[i : i + LONGEST_RUN]
        size = len(part).bit_length() - 1
        code = f"{size:04b}" + (f"{len(part) - (1 << size):0{size}b}" if size else "")
        parts += [np.frombuffer(code.encode(), np.uint8) - 48, part.ravel()]
    return _packed(np.concatenate(parts))


#: Of the files that encode() writes; the first scans have one code, of one bit, and so eight bits a coefficient.
TABLES = _table(0, 0, {1: b"\x00"}) + _table(1, 0, {1: b"\x07"}) + _table(1, 1, {4: bytes(range(0x00, 0xF0, 0x10))})
QUANTS = _segment(0xDB, bytes([0]) + bytes([1]) * 64)
JFIF = _segment(0xE0, b"JFIF\x00\x01\x02\x00\x00\x01\x00\x01\x00\x00")


def payload(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def encode(data: bytes, note: bytes = b"") -> bytes:
    """A progressive JPEG whose coefficients hold the data."""
    mcus = max(1, -(-len(data) // PER_MCU))
    across = int(np.ceil(np.sqrt(mcus)))
    down = -(-mcus // across)
    n = across * down
    flat = np.full(n * PER_MCU, 255, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    half = (flat & 127) >> 1 | 64
    high = np.where(flat >> 7, half ^ 127, half).astype(np.uint8).reshape(6 * n, 63)
    low = (flat & 1).reshape(6 * n, 63)
    planes = {1: slice(0, 4 * n), 2: slice(4 * n, 5 * n), 3: slice(5 * n, 6 * n)}
    frame = struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", JFIF, _segment(0xFE, b"%d %s" % (len(data), note)), QUANTS, _segment(0xC2, frame), TABLES]
    out.append(_scan([1, 2, 3], 0, 0, 0, 0, 0x00, _packed(np.zeros(6 * n, np.uint8))))
    out += [_scan([1], a, b, 0, 1, 0x00, np.ascontiguousarray(high[planes[1], a - 1 : b]).tobytes()) for a, b in ((1, 5), (6, 63))]
    out += [_scan([c], 1, 63, 0, 1, 0x00, high[planes[c]].tobytes()) for c in (2, 3)]
    out += [_scan([c], 1, 63, 1, 0, 0x01, _refinement(low[planes[c]])) for c in (1, 2, 3)]
    return b"".join([*out, b"\xff\xd9"])


# decoding


@dataclass
class Component:
    h: int
    v: int
    quant: int
    coefs: np.ndarray | None = None  # (block rows, block columns, 64), zigzag, whole MCUs
    rows: int = 0  # of blocks that the component itself has
    cols: int = 0


@dataclass
class Image:
    height: int = 0
    width: int = 0
    components: dict[int, Component] = field(default_factory=dict)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""


class Bits:
    """Bits of one entropy-coded segment, byte stuffing removed."""

    def __init__(self, data: bytes):
        self.data, self.at, self._bits = data, 0, None

    @property
    def bits(self) -> np.ndarray:
        if self._bits is None:
            self._bits = np.unpackbits(np.frombuffer(self.data, np.uint8))
        return self._bits

    def take(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise ValueError("the scan ends early")
        v = 0
        for b in self.bits[self.at : self.at + n].tolist():
            v = 2 * v + b
        self.at += n
        return v

    def many(self, n: int) -> np.ndarray:
        if self.at + n > 8 * len(self.data):
            raise ValueError("the scan ends early")
        self.at += n
        return self.bits[self.at - n : self.at]

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        v = 0
        for n in range(1, 17):
            v = 2 * v + self.take(1)
            if (n, v) in codes:
                return codes[n, v]
        raise ValueError("no such code")


def _codes(lengths: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    codes, code, at = {}, 0, 0
    for n, k in enumerate(lengths, 1):
        for s in symbols[at : at + k]:
            codes[n, code] = s
            code += 1
        at, code = at + k, 2 * code
    return codes


def _signed(v: int, size: int) -> int:
    return v if size == 0 or v >> (size - 1) else v - (1 << size) + 1


def _dc(bits: Bits, blocks: list, codes: dict | None, high: int, low: int) -> None:
    """blocks: (component, blocks of 64, index) in order of the scan."""
    if high:
        for (_, store, i), b in zip(blocks, bits.many(len(blocks)).tolist()):
            store[i, 0] |= b << low
        return
    last: dict[int, int] = {}
    at = 0
    if codes.get((1, 0)) == 0:  # no difference: a run of bits 0
        end = min(8 * len(bits.data), len(blocks))
        ones = np.flatnonzero(bits.bits[:end])
        at = bits.at = int(ones[0]) if len(ones) else end
    for c, store, i in blocks[at:]:
        size = bits.symbol(codes)
        last[c] = last.get(c, 0) + _signed(bits.take(size), size)
        store[i, 0] = last[c] << low


def _ac_first(bits: Bits, band: np.ndarray, codes: dict, low: int) -> None:
    """band: (blocks, coefficients of the scan), filled in place."""
    i, n, width, fixed = 0, len(band), band.shape[1], codes.get((1, 0), 0)
    fixed = fixed if 0 < fixed < 16 else 0  # a code of one bit for a size without zeros before it
    while i < n:
        if fixed:
            each = 1 + fixed
            whole = min(n - i, (8 * len(bits.data) - bits.at) // (each * width))
            if each == 8 and bits.at % 8 == 0:
                v = np.frombuffer(bits.data, np.uint8, whole * width, bits.at // 8).reshape(whole, width).astype(np.int16)
                bad = v > 127
            else:
                b = bits.bits[bits.at : bits.at + whole * each * width].reshape(whole, width, each)
                v, bad = b[:, :, 1:].astype(np.int16) @ (1 << np.arange(fixed - 1, -1, -1)).astype(np.int16), b[:, :, 0] > 0
            odd = np.flatnonzero(bad.any(axis=1))
            good = int(odd[0]) if len(odd) else whole
            v = v[:good]
            band[i : i + good] = np.where(v >> (fixed - 1), v, v - ((1 << fixed) - 1)) << low
            bits.at += good * each * width
            i += good
            if i == n:
                return
        k = 0
        while k < width:
            run, size = divmod(bits.symbol(codes), 16)
            if size:
                k += run
                if k >= width:
                    raise ValueError("a run passes the end of its band")
                band[i, k] = _signed(bits.take(size), size) << low
                k += 1
            elif run == 15:
                k += 16
            else:
                i += (1 << run) + bits.take(run) - 1
                break
        i += 1


def _ac_refine(bits: Bits, band: np.ndarray, codes: dict, low: int) -> None:
    one, n, width = 1 << low, len(band), band.shape[1]

    def correct(block: np.ndarray, at: np.ndarray) -> None:
        got = at[bits.many(len(at)) > 0]
        got = got[(block[got] & one == 0) if block.ndim == 1 else ...]
        block[got] += np.where(block[got] > 0, one, -one).astype(block.dtype)

    i = 0
    while i < n:
        k, ended = 0, 0
        while k < width:
            run, size = divmod(bits.symbol(codes), 16)
            new = 0
            if size:
                new = one if bits.take(1) else -one
            elif run < 15:
                ended = (1 << run) + bits.take(run)
                break
            # pass over `run` zeros (16 for a code of zeros alone), correcting what is not zero
            zeros = np.flatnonzero(band[i, k:] == 0) + k
            if len(zeros) <= run and size:
                raise ValueError("a run passes the end of its band")
            stop = int(zeros[run]) if len(zeros) > run else width
            correct(band[i], np.flatnonzero(band[i, k:stop]) + k)
            if size:
                band[i, stop] = new
            k = stop + 1
        if ended:
            if i + ended > n:
                raise ValueError("an end-of-band run passes the end of its scan")
            correct(band[i], np.flatnonzero(band[i, k:]) + k)
            if ended > 1:
                rest = band[i + 1 : i + ended].reshape(-1)
                correct(rest, np.flatnonzero(rest))
            i += ended
        else:
            i += 1


def coefficients(jpeg: bytes) -> Image:
    """All coefficients of a progressive JPEG, from all its scans."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    image, tables, interval, at = Image(), {}, 0, 2
    while True:
        if at + 4 > len(jpeg) or jpeg[at] != 0xFF:
            if jpeg[at : at + 2] == b"\xff\xd9":
                return image
            raise ValueError("the image ends early")
        marker = jpeg[at + 1]
        if marker == 0xD9:
            return image
        if marker == 0xFF:
            at += 1
            continue
        end = at + 2 + int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body = jpeg[at + 4 : end]
        at = end
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xDB:
            while body:
                size = 128 if body[0] >> 4 else 64
                image.quants[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if size == 128 else np.uint8).astype(np.float32)
                body = body[1 + size :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            _, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            image.components = {body[6 + 3 * i]: Component(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
            hm, vm = max(c.h for c in image.components.values()), max(c.v for c in image.components.values())
            for c in image.components.values():
                c.cols, c.rows = -(-(-(-image.width * c.h // hm)) // 8), -(-(-(-image.height * c.v // vm)) // 8)
                c.coefs = np.zeros((-(-image.height // (8 * vm)) * c.v, -(-image.width // (8 * hm)) * c.h, 64), np.int16)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only progressive JPEG with Huffman codes is read")
        elif marker == 0xDA:
            following = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.S).search(jpeg, at)
            if not following:
                raise ValueError("the image ends early")
            data = jpeg[at : following.start()]
            at = following.start()
            _read_scan(image, tables, interval, body, data)


def _read_scan(image: Image, tables: dict, interval: int, head: bytes, data: bytes) -> None:
    chosen = [(head[1 + 2 * i], head[2 + 2 * i]) for i in range(head[0])]
    first, last, high, low = head[-3], head[-2], head[-1] >> 4, head[-1] & 15
    if first == 0:
        order = []
        one = len(chosen) == 1
        parts = [(c, t, image.components[c]) for c, t in chosen]
        grid = (parts[0][2].rows, parts[0][2].cols) if one else (parts[0][2].coefs.shape[0] // parts[0][2].v, parts[0][2].coefs.shape[1] // parts[0][2].h)
        stores = {c: comp.coefs.reshape(-1, 64) for c, _, comp in parts}
        fast = not high and all(tables[t >> 4].get((1, 0)) == 0 for _, t, _ in parts) and not interval
        units = grid[0] * grid[1] * sum(1 if one else comp.h * comp.v for _, _, comp in parts)
        if fast and not np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))[:units].any():
            return  # every difference is zero
        for r in range(grid[0]):
            for c in range(grid[1]):
                unit = []
                for key, t, comp in parts:
                    h, v = (1, 1) if one else (comp.h, comp.v)
                    unit += [(key, t, (r * v + y) * comp.coefs.shape[1] + c * h + x) for y in range(v) for x in range(h)]
                order.append(unit)
    else:
        ((key, t),) = chosen
        comp = image.components[key]
        band = comp.coefs[: comp.rows, : comp.cols, first : last + 1].copy().reshape(-1, last - first + 1)
        order = range(len(band))
    step = interval or len(order)
    pieces = re.split(rb"\xff[\xd0-\xd7]", data) if interval else [data]
    for i, piece in zip(range(0, len(order), step), pieces):
        bits = Bits(piece.replace(b"\xff\x00", b"\xff"))
        if first:
            (_ac_refine if high else _ac_first)(bits, band[i : i + step], tables[0x10 | t & 15], low)
        else:
            blocks = [(key, t, j) for unit in order[i : i + step] for key, t, j in unit]
            same = len({t >> 4 for _, t, _ in blocks}) == 1
            if high or same:
                _dc(bits, [(key, stores[key], j) for key, _, j in blocks], None if high else tables[blocks[0][1] >> 4], high, low)
            else:
                _dc_mixed(bits, blocks, stores, tables, low)
    if first:
        comp.coefs[: comp.rows, : comp.cols, first : last + 1] = band.reshape(comp.rows, comp.cols, -1)


def _dc_mixed(bits: Bits, blocks: list, stores: dict, tables: dict, low: int) -> None:
    last: dict[int, int] = {}
    for key, t, j in blocks:
        size = bits.symbol(tables[t >> 4])
        last[key] = last.get(key, 0) + _signed(bits.take(size), size)
        stores[key][j, 0] = last[key] << low


def tensor(image: Image) -> np.ndarray:
    """RGB (height, width, 3) of 8 bits at full resolution."""
    hm, vm = max(c.h for c in image.components.values()), max(c.v for c in image.components.values())
    planes = []
    for c in image.components.values():
        rows, cols, _ = c.coefs.shape
        scaled = c.coefs.reshape(-1, 64).astype(np.float32)
        quant = image.quants[c.quant]
        if (quant != 1).any():
            scaled *= quant
        samples = np.clip(scaled @ BASIS + 128, 0, 255).reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * cols)
        if (vm // c.v, hm // c.h) != (1, 1):
            samples = samples.repeat(vm // c.v, axis=0).repeat(hm // c.h, axis=1)
        planes.append(samples[: image.height, : image.width])
    out = np.empty((image.height, image.width, 3), np.uint8)
    if len(planes) == 1:
        out[:] = np.rint(planes[0])[:, :, None]
        return out
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    for k, (b, r) in enumerate(((0, 1.402), (-0.344136, -0.714136), (1.772, 0))):
        v = y + b * cb if b else y.copy()
        if r:
            v += np.float32(r) * cr
        out[:, :, k] = np.clip(v, 0, 255) + np.float32(0.5)
    return out


def stored_bytes(image: Image) -> bytes:
    """The data that encode() put in the coefficients."""
    n = int(image.comment.split()[0])
    flat = np.concatenate([c.coefs[: c.rows, : c.cols, 1:].reshape(-1) for c in image.components.values()])[:n]
    return ((np.abs(flat) - 128) | (flat < 0).astype(np.int16) << 7).astype(np.uint8).tobytes()


def feature(rgb: np.ndarray) -> str:
    """Size, and mean and standard deviation of each channel."""
    flat = rgb.reshape(-1, 3)
    n, total = len(flat), flat.sum(axis=0, dtype=np.int64)
    squares = [int(np.dot(h := np.bincount(flat[:, k], minlength=256), np.arange(256) ** 2)) for k in range(3)]
    means = total / n
    return f"{rgb.shape[1]}x{rgb.shape[0]} " + " ".join(f"{m:.3f}/{max(0.0, q / n - m * m) ** 0.5:.3f}" for m, q in zip(means, squares))


# columns


def _encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", 1 << 22):
        sizes, media = [], []
        for t in b.column("text").to_pylist():
            raw = (t or "").encode()
            sizes.append(len(raw))
            media.append(encode(payload(raw)))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def with_media(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as (doc_id, n_bytes, media): each text's payload as one image."""
    return arrow(_encode_rows, docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, n_bytes long, media binary")


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "media", 1 << 22):
        rows = []
        for doc, n, media in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media").to_pylist()):
            image = coefficients(media)
            data = stored_bytes(image)
            rows.append((doc, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(tensor(image))))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "sha256" in k or k == "feature" else pa.int64()) for k, c in zip(NAMES, zip(*rows))], NAMES)


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def _tensor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "media", 1 << 20):
        for i, media in enumerate(b.column("media").to_pylist()):
            rgb = tensor(coefficients(media))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, 1), pa.array([rgb.shape[0]], pa.int32()), pa.array([rgb.shape[1]], pa.int32()), pa.array([rgb.tobytes()], pa.binary())], ["doc_id", "height", "width", "rgb"])


def tensors(media: DataFrame) -> DataFrame:
    """(doc_id, media) of any progressive JPEGs as full-resolution tensors (doc_id, height, width, rgb)."""
    return arrow(_tensor_rows, media.select("doc_id", "media"), "doc_id long, height int, width int, rgb binary")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(with_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    return arrow(_read_rows, media, ", ".join(f"{k} {'string' if 'sha256' in k or k == 'feature' else 'long'}" for k in NAMES))
