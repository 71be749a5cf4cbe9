"""Media columns: payloads kept as baseline JPEG images, read back by a decoder in numpy.

`encode` stores a payload losslessly: each byte is one quantised coefficient of a grayscale image (64 bytes a block, in
zigzag order, DC first; quantisers all 1). Byte b is the coefficient 256 + b, which has the size category 9 for every b, so each
Huffman table has one symbol with the one-bit code 0, and a coefficient takes 10 bits. Restart markers after each block
make its DC difference the DC value itself. Any baseline decoder reads such a file.

`decode` parses the markers of a baseline file, decodes the Huffman scan, and returns dimensions, coefficients and the
DC-only luminance thumbnail: one sample for each block, 128 + DC * quantiser / 8, clipped to 0..255. Scans whose tables have one
symbol each are decoded by vectorised bit operations, PART blocks at a time; all other scans code by code through a table of all 16-bit
beginnings, in time linear in the scan, with interleaved components and sampling factors.

Defined cases: null is the empty payload (64 zero bytes, one block). Rows of one text have equal values. A null id is carried as
null, and other columns are left aside. A text of up to 4 GB fits (the grid has at most 8,191 * 8,191 blocks).
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ._shared import table

UNIT = 64
SIZE = 9  # category of 256..511
#: Blocks that are coded at a time.
PART = 1 << 14


def padded(raw: bytes) -> bytes:
    """raw with zero bytes up to a positive multiple of UNIT."""
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\0")


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">HH", marker, len(body) + 2) + body


def _one_symbol(kind: int, symbol: int) -> bytes:
    return bytes([kind << 4, 1, *[0] * 15, symbol])


def _coded(grid: np.ndarray, first: int) -> bytes:
    """The entropy-coded blocks of some rows of bytes, each with the restart marker behind it. first: the number of the first block."""
    # Ten bits for a coefficient: 01 and the byte. Four of them are five bytes.
    four = grid.reshape(-1, 4).astype(np.uint64) | np.uint64(256)
    bits = (four[:, 0] << np.uint64(30)) | (four[:, 1] << np.uint64(20)) | (four[:, 2] << np.uint64(10)) | four[:, 3]
    out = np.empty((len(grid), 82), np.uint8)
    out[:, :80] = (bits << np.uint64(24)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5].reshape(len(grid), 80)
    out[:, 80], out[:, 81] = 0xFF, 0xD0 + (first + np.arange(len(grid))) % 8
    stuffed = out == 0xFF
    stuffed[:, 80:] = False
    flat = out.reshape(-1)
    return np.insert(flat, np.flatnonzero(stuffed.reshape(-1)) + 1, 0).tobytes() if stuffed.any() else flat.tobytes()


def encode(payload: bytes) -> bytes:
    """A baseline JPEG file that holds payload, whose length is a positive multiple of UNIT; its length stands in a comment."""
    blocks = len(payload) // UNIT
    across = math.isqrt(blocks - 1) + 1
    down = -(-blocks // across)
    if across > 8191:
        raise ValueError("the payload is too long for one image")
    body = []
    for k in range(0, across * down, PART):
        grid = np.zeros((min(PART, across * down - k), UNIT), np.uint8)
        own = np.frombuffer(payload[k * UNIT : (k + len(grid)) * UNIT], np.uint8)
        grid.reshape(-1)[: len(own)] = own
        body.append(_coded(grid, k))
    body[-1] = body[-1][:-2]  # no restart after the last block
    head = [
        b"\xff\xd8",
        _segment(0xFFDB, b"\0" + b"\1" * 64),
        _segment(0xFFFE, struct.pack(">Q", len(payload))),
        _segment(0xFFC0, struct.pack(">BHHBBBB", 8, 8 * down, 8 * across, 1, 1, 0x11, 0)),
        _segment(0xFFC4, _one_symbol(0, SIZE) + _one_symbol(1, SIZE)),
        _segment(0xFFDD, struct.pack(">H", 1)),
        _segment(0xFFDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ]
    return b"".join([*head, *body, b"\xff\xd9"])


@dataclass
class Image:
    width: int = 0
    height: int = 0
    comment: bytes = b""
    #: For each component its blocks, (rows, columns, 64) in zigzag order, quantised.
    coefficients: list[np.ndarray] = field(default_factory=list)
    thumbnail: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.uint8))


def _huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    codes, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            codes[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return codes


def _read_scan(scan: bytes) -> list[bytes]:
    """The entropy-coded segments between restart markers, without stuffing."""
    parts, at, start = [], 0, 0
    while (at := scan.find(b"\xff", at)) >= 0:
        if scan[at + 1 : at + 2] and 0xD0 <= scan[at + 1] <= 0xD7:
            parts.append(scan[start:at])
            start = at + 2
        at += 2
    parts.append(scan[start:])
    return [p.replace(b"\xff\x00", b"\xff") for p in parts]


def _fixed(scan: bytes, blocks: int, restart: int, dc: dict, ac: dict) -> np.ndarray | None:
    """Blocks of a scan in which every code has one length; None if the tables or the layout are others."""
    if restart != 1 or len(dc) != 1 or len(ac) != 1:
        return None
    ((dc_bits, _), dc_size), ((ac_bits, _), symbol) = next(iter(dc.items())), next(iter(ac.items()))
    if symbol >> 4 or symbol & 15 != dc_size or dc_bits != ac_bits or dc_bits + dc_size != 10:
        return None
    raw = np.frombuffer(scan, np.uint8)
    if len(raw) != 82 * blocks - 2:
        ff = raw[:-1] == 0xFF
        ff &= raw[1:] == 0
        raw = np.delete(raw, np.flatnonzero(ff) + 1)
        if len(raw) != 82 * blocks - 2:
            return None
    out = np.empty((blocks * 16, 4), np.int16)
    for k in range(0, blocks, PART):
        part = raw[82 * k : 82 * (k + PART)]
        rows = np.empty((-(-len(part) // 82), 82), np.uint8)
        rows.reshape(-1)[: len(part)] = part
        rows.reshape(-1)[len(part) :] = (0xFF, 0xD0)[: rows.size - len(part)]
        if (rows[:, 80] != 0xFF).any() or (rows[:, 81] & 0xF8 != 0xD0).any():
            return None
        wide = np.zeros((len(rows) * 16, 8), np.uint8)
        wide[:, 3:] = rows[:, :80].reshape(-1, 5)
        bits = wide.reshape(-1).view(">u8").astype(np.uint64)
        for c in range(4):
            v = ((bits >> np.uint64(30 - 10 * c)) & np.uint64((1 << dc_size) - 1)).astype(np.int16)
            if dc_size and (v < (1 << (dc_size - 1))).any():
                v = np.where(v < (1 << (dc_size - 1)), v - (1 << dc_size) + 1, v)  # a leading 0: negative
            out[k * 16 : k * 16 + len(v), c] = v
    return out.reshape(blocks, UNIT)


def _lookup(codes: dict) -> list[int]:
    """For each 16 bits, length * 256 + symbol of the code that they begin with; 0 where there is none."""
    table = [0] * (1 << 16)
    for (length, code), symbol in codes.items():
        span = 1 << (16 - length)
        table[code * span : (code + 1) * span] = [length << 8 | symbol] * span
    return table


class _Bits:
    """Bits of a segment, 64 at a time, so that the work grows with its length only. Behind the end all bits are 1."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.value, self.left = raw, 0, 0, 0

    def _more(self) -> None:
        if self.at > len(self.raw) + 16:
            raise ValueError("the scan ends too early")
        eight = self.raw[self.at : self.at + 8].ljust(8, b"\xff")
        self.value = (self.value & ((1 << self.left) - 1)) << 64 | int.from_bytes(eight, "big")
        self.left += 64
        self.at += 8

    def take(self, n: int) -> int:
        if self.left < n:
            self._more()
        self.left -= n
        return (self.value >> self.left) & ((1 << n) - 1)

    def symbol(self, table: list[int]) -> int:
        if self.left < 16:
            self._more()
        found = table[(self.value >> (self.left - 16)) & 0xFFFF]
        if not found:
            raise ValueError("no such Huffman code")
        self.left -= found >> 8
        return found & 255

    def number(self, size: int) -> int:
        v = self.take(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _block(bits: _Bits, before: int, dc: list[int], ac: list[int], out: np.ndarray) -> int:
    out[0] = before + bits.number(bits.symbol(dc))
    k = 1
    while k < 64:
        run, size = divmod(bits.symbol(ac), 16)
        if not size and run < 15:
            break
        k += run
        if size:
            out[k] = bits.number(size)
        k += 1
    return int(out[0])


def decode(raw: bytes) -> Image:
    """Reads a baseline file. Raises ValueError for anything else."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    image, at, quant, tables, restart, frame = Image(), 2, {}, {}, 0, []
    while at + 4 <= len(raw):
        marker, size = struct.unpack_from(">HH", raw, at)
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFFFE:
            image.comment = body
        elif marker == 0xFFDB:
            while body:
                wide = 1 + (body[0] >> 4)
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8)
                body = body[1 + 64 * wide :]
        elif marker == 0xFFC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xFFDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xFFC0:
            bits, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("samples of 8 bits only")
            frame = [(c, s >> 4, s & 15, q) for c, s, q in (body[6 + 3 * k : 9 + 3 * k] for k in range(n))]
        elif 0xFFC1 <= marker <= 0xFFCF:
            raise ValueError("baseline files only")
        elif marker == 0xFFDA:
            use = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            end = raw.rfind(b"\xff\xd9")
            _scan(image, raw[at : end if end >= at else len(raw)], frame, use, tables, restart)
            break
        elif marker >> 8 != 0xFF:
            raise ValueError("a marker is missing")
    if not image.coefficients:
        raise ValueError("no scan")
    y = image.coefficients[0][:, :, 0].astype(np.int32) * int(quant[frame[0][3]][0])
    image.thumbnail = np.clip(128 + (y >> 3), 0, 255).astype(np.uint8)
    return image


def _scan(image: Image, scan: bytes, frame: list, use: dict, tables: dict, restart: int) -> None:
    if {c for c, *_ in frame} != set(use):
        raise ValueError("one scan with all components only")
    h, v = max(f[1] for f in frame), max(f[2] for f in frame)
    alone = len(frame) == 1
    across, down = -(-image.width // (8 * (1 if alone else h))), -(-image.height // (8 * (1 if alone else v)))
    shape = [(down * (1 if alone else fv), across * (1 if alone else fh)) for _, fh, fv, _ in frame]
    coded = [(tables[use[c] >> 4], tables[16 | use[c] & 15]) for c, *_ in frame]
    if alone and (fixed := _fixed(scan, across * down, restart, *coded[0])) is not None:
        image.coefficients = [fixed.reshape(*shape[0], UNIT)]
        return
    tables_of = {id(t): _lookup(t) for pair in coded for t in pair}
    coded = [(tables_of[id(dc)], tables_of[id(ac)]) for dc, ac in coded]
    image.coefficients = [np.zeros((*s, UNIT), np.int16) for s in shape]
    parts, bits, before = iter(_read_scan(scan)), None, []
    for mcu in range(across * down):
        if bits is None or restart and mcu % restart == 0:
            bits, before = _Bits(next(parts)), [0] * len(frame)
        row, column = divmod(mcu, across)
        for k, (_, fh, fv, _) in enumerate(frame):
            fh, fv = (1, 1) if alone else (fh, fv)
            for b in range(fh * fv):
                out = image.coefficients[k][row * fv + b // fh, column * fh + b % fh]
                before[k] = _block(bits, before[k], *coded[k], out)


def payload(image: Image) -> bytes:
    """The payload that encode stored."""
    (size,) = struct.unpack(">Q", image.comment)
    return image.coefficients[0].reshape(-1)[:size].astype(np.uint8).tobytes()  # 256 + b modulo 256


def feature(image: Image) -> str:
    """Dimensions and the thumbnail's hash."""
    return f"{image.width}x{image.height}:{xxhash.xxh3_64_hexdigest(image.thumbnail.tobytes())}"


COLUMNS = {"n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}


def _columns(keep: bool):
    def run(batches):
        for batch in batches:
            rows, stored = [], []
            for text in batch.column("text"):
                raw = (text.as_py() or "").encode()
                file = encode(padded(raw))
                image = decode(file)
                back = payload(image)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), feature(image)))
                if keep:
                    stored.append(file)
            columns = [pa.array(c, pa.string() if t == "string" else pa.int64()) for c, t in zip(zip(*rows) if rows else [[]] * len(COLUMNS), COLUMNS.values())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, *([pa.array(stored, pa.binary())] if keep else [])], names=["doc_id", *COLUMNS, *(["media"] if keep else [])])

    return run


def media_columns(docs: DataFrame, *, keep_media: bool = False) -> DataFrame:
    """doc_id and COLUMNS for each row of docs; with keep_media also the file, in the column media."""
    docs = docs.select("doc_id", "text")
    schema = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *(f"{c} {t}" for c, t in COLUMNS.items()), *(["media binary"] if keep_media else [])])
    return docs.mapInArrow(_columns(keep_media), schema)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
