"""Media columns: bytes kept as progressive JPEG coefficients and read back as full-resolution RGB tensors.

Writing: a payload of n blocks of 64 bytes becomes the quantised coefficients of a 4:2:0 colour image, byte b as the
coefficient b - 130 below 128 and b - 126 from there on, so no coefficient vanishes when its last bit is left out. The
image is written as progressive scans: DC without its last bit, AC 1-5 and 6-63 without theirs, then the last bits of
DC and of AC. A comment segment keeps the payload's length. Coefficients are coded as they are, so the bytes come back.

Reading: any progressive, Huffman-coded image with 8-bit samples. The scans are accumulated into coefficient arrays,
these are dequantised and inverse-transformed in numpy, chroma is upsampled by repetition and RGB is formed at full
resolution. The table that this writer uses gives every non-zero coefficient without a zero before it nine bits, so
such a scan is read by whole arrays; all other scans are read symbol by symbol.

Defined cases: a null text is the empty text and gets one block of zeros; repeated rows give repeated rows; a null
doc_id stays null; an empty table gives no rows; other columns are ignored. Equal texts give equal files.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalens.llm.common import whole_text

BLOCK = 64
#: Fixed value: largest number of 16-pixel rows or columns of an image.
SIDE = 4095
_NOTE = b"bytes:"


@cache
def zigzag() -> np.ndarray:
    """Natural positions of the 64 coefficients in zigzag order."""
    return np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


@cache
def cosines() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(8)[None]
    return np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)


class Huffman:
    """Codes by symbol and symbols by (length, code), in the canonical order of a DHT segment."""

    def __init__(self, counts: list[int], symbols: list[int]):
        self.counts, self.symbols, self.code, self.symbol = counts, symbols, {}, {}
        code, at = 0, 0
        for n, many in enumerate(counts, 1):
            for s in symbols[at : at + many]:
                self.code[s], self.symbol[n, code] = (code, n), s
                code += 1
            at, code = at + many, code << 1
        # a symbol of size s in 9 - s bits, each with its s bits after it: nine bits whatever the size
        self.nine = symbols[:8] == list(range(8, 0, -1)) and counts[:8] == [1] * 8

    def segment(self, kind: int) -> bytes:
        return bytes([kind, *self.counts, *self.symbols])


@cache
def writer_table(dc: bool) -> Huffman:
    """Sizes 8 to 1 in 1 to 8 bits; DC has size 0 in 9 bits, AC all other run/size and end-of-band symbols in 16."""
    first = list(range(8, 0, -1))
    if dc:
        return Huffman([1] * 9 + [0] * 7, [*first, 0])
    rest = [r << 4 | s for r in range(16) for s in range(11) if r or s not in range(1, 9)]
    return Huffman([1] * 8 + [0] * 7 + [len(rest)], [*first, *rest])


@cache
def nine_bits() -> np.ndarray:
    """The value that each nine-bit word codes: leading ones give the size, the last bits the value; 0 where not so."""
    out = np.zeros(512, np.int32)
    for w in range(510):
        size = 8 - next(i for i in range(9) if not w >> (8 - i) & 1)
        if size:
            bits = w & ((1 << size) - 1)
            out[w] = bits if bits >> (size - 1) else bits - (1 << size) + 1
    return out


@cache
def nine_words() -> np.ndarray:
    """The word of each value from -255 to 255, at value + 255."""
    out = np.zeros(511, np.int32)
    values = nine_bits()
    out[values[values != 0] + 255] = np.flatnonzero(values)
    out[255] = 510
    return out


def joined(words: np.ndarray) -> bytes:
    """Nine-bit words one after another, the last byte filled with ones."""
    bits = np.unpackbits(words.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, 7:]
    return padded(bits.ravel())


def separated(data: bytes, n: int) -> np.ndarray:
    """The first n nine-bit words."""
    wide = np.zeros((n, 16), np.uint8)
    wide[:, 7:] = np.unpackbits(np.frombuffer(data, np.uint8), count=9 * n).reshape(n, 9)
    return np.packbits(wide, axis=1).view(">u2").ravel()


class Bits:
    """A bit string to write to or to read from, one number at a time."""

    def __init__(self, data: bytes = b""):
        self.data, self.at, self.out = data, 0, []

    def put(self, value: int, n: int) -> None:
        self.out += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def done(self) -> bytes:
        return np.packbits(np.array(self.out + [1] * (-len(self.out) % 8), np.uint8)).tobytes()

    def bit(self) -> int:
        at = self.at
        self.at += 1
        return self.data[at >> 3] >> (7 - (at & 7)) & 1 if at >> 3 < len(self.data) else 1

    def get(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v

    def symbol(self, table: Huffman) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.bit()
            if (n, code) in table.symbol:
                return table.symbol[n, code]
        raise ValueError("no such code")

    def value(self, size: int) -> int:
        v = self.get(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def put_value(out: Bits, v: int, size: int) -> None:
    out.put(v if v >= 0 else v + (1 << size) - 1, size)


# Scans: one component's blocks (rows of 64 coefficients in zigzag order) to bytes and back.


def write_dc(blocks: np.ndarray, low: int) -> bytes:
    diff = blocks[:, 0] >> low
    diff[1:] -= diff[:-1].copy()
    if diff.min() >= -255 and diff.max() <= 255:
        return joined(nine_words()[diff + 255])
    raise ValueError("a DC coefficient out of range")


def read_dc(data: bytes, blocks: np.ndarray, low: int, table: Huffman) -> None:
    n = len(blocks)
    if table.nine and table.counts == writer_table(True).counts and table.symbols == writer_table(True).symbols:
        diff = nine_bits()[separated(data, n)]
    else:
        bits = Bits(data)
        diff = np.array([bits.value(bits.symbol(table)) for _ in range(n)])
    blocks[:, 0] = np.cumsum(diff) << low


def write_ac(blocks: np.ndarray, start: int, end: int, low: int) -> bytes:
    band = blocks[:, start : end + 1]
    v = (band + (band < 0) * ((1 << low) - 1)) >> low  # towards zero
    if v.min() >= -255 and v.max() <= 255 and v.all():
        return joined(nine_words()[v.ravel() + 255])
    table, out, run = writer_table(False), Bits(), 0
    for row in v:
        zeros, last = 0, max(np.flatnonzero(row), default=-1)
        if last >= 0:
            run = end_run(out, table, run)
        for x in row[: last + 1].tolist():
            if not x:
                zeros += 1
                continue
            while zeros > 15:
                out.put(*table.code[0xF0])
                zeros -= 16
            size = abs(x).bit_length()
            out.put(*table.code[zeros << 4 | size])
            put_value(out, x, size)
            zeros = 0
        if last < end - start:
            run += 1
            if run == 32767:
                run = end_run(out, table, run)
    end_run(out, table, run)
    return out.done()


def end_run(out: Bits, table: Huffman, run: int) -> int:
    """Says that `run` blocks have no more coefficients in this band."""
    if run:
        n = run.bit_length() - 1
        out.put(*table.code[n << 4])
        out.put(run - (1 << n), n)
    return 0


def read_ac(data: bytes, blocks: np.ndarray, start: int, end: int, low: int, table: Huffman) -> None:
    n = len(blocks) * (end - start + 1)
    if table.nine and len(data) * 8 >= n * 9:
        v = nine_bits()[separated(data, n)]
        if v.all():
            blocks[:, start : end + 1] = v.reshape(len(blocks), -1) << low
            return
    bits, run = Bits(data), 0
    for row in blocks:
        if run:
            run -= 1
            continue
        k = start
        while k <= end:
            r, size = divmod(bits.symbol(table), 16)
            if size:
                k += r
                row[k] = bits.value(size) << low
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) + bits.get(r) - 1
                break


def write_dc_bit(blocks: np.ndarray, low: int) -> bytes:
    return padded((blocks[:, 0] >> low & 1).astype(np.uint8))


def padded(bits: np.ndarray) -> bytes:
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


def read_dc_bit(data: bytes, blocks: np.ndarray, low: int) -> None:
    blocks[:, 0] |= np.unpackbits(np.frombuffer(data, np.uint8))[: len(blocks)].astype(np.int32) << low


def write_ac_bit(blocks: np.ndarray, start: int, end: int, low: int) -> bytes:
    """One more bit of every coefficient that is known already, and the sign of those that appear with this bit."""
    size = np.abs(blocks[:, start : end + 1]) >> low
    table, parts = writer_table(False), []
    if (size > 1).all():
        for at in range(0, len(size), 32767):
            part, out = size[at : at + 32767], Bits()
            end_run(out, table, len(part))
            parts += [np.array(out.out, np.uint8), (part & 1).ravel().astype(np.uint8)]
        return padded(np.concatenate(parts))
    out = Bits()
    for row, full in zip(size.tolist(), blocks[:, start : end + 1].tolist(), strict=True):
        last = max((i for i, x in enumerate(row) if x == 1), default=-1)
        zeros, waiting = 0, []
        for i, x in enumerate(row):
            if not x:
                zeros += 1
                continue
            while zeros > 15 and i <= last:
                out.put(*table.code[0xF0])
                out.out += waiting
                zeros, waiting = zeros - 16, []
            if x > 1:
                waiting.append(x & 1)
            else:
                out.put(*table.code[zeros << 4 | 1])
                out.put(int(full[i] > 0), 1)
                out.out += waiting
                zeros, waiting = 0, []
        if last < end - start:
            out.put(*table.code[0])
            out.out += waiting
    return out.done()


def read_ac_bit(data: bytes, blocks: np.ndarray, start: int, end: int, low: int, table: Huffman) -> None:
    band = blocks[:, start : end + 1]
    if band.all():
        bits, at = Bits(data), 0
        whole = np.unpackbits(np.frombuffer(data, np.uint8))
        while at < len(blocks):
            r, size = divmod(bits.symbol(table), 16)
            if size or r == 15:
                break
            n = min((1 << r) + bits.get(r), len(blocks) - at)
            many = n * band.shape[1]
            more = whole[bits.at : bits.at + many].reshape(n, -1).astype(np.int32) << low
            band[at : at + n] += np.sign(band[at : at + n]) * more
            bits.at += many
            at += n
        else:
            return
        if at:
            raise ValueError("symbols that a full band cannot have")
    bits, run, one = Bits(data), 0, 1 << low
    for row in blocks:
        k = start
        while k <= end and not run:
            r, size = divmod(bits.symbol(table), 16)
            new = 0
            if size:
                new = one if bits.bit() else -one
            elif r < 15:
                run = (1 << r) + bits.get(r)
                break
            while k <= end:
                if row[k]:
                    if bits.bit():
                        row[k] += one if row[k] > 0 else -one
                elif r == 0:
                    if new:
                        row[k] = new
                    k += 1
                    break
                else:
                    r -= 1
                k += 1
        if run:
            for i in range(k, end + 1):
                if row[i] and bits.bit():
                    row[i] += one if row[i] > 0 else -one
            run -= 1


# Files.


def stuffed(data: bytes) -> bytes:
    return data.replace(b"\xff", b"\xff\x00")


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode_image(components: list[np.ndarray], width: int, height: int, note: bytes = b"") -> bytes:
    """A 4:2:0 progressive image of the components' quantised coefficients, with all quantisers 1."""
    out = [b"\xff\xd8", segment(0xFE, note) if note else b"", segment(0xDB, bytes([0] + [1] * 64))]
    out.append(segment(0xC2, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(segment(0xC4, writer_table(True).segment(0x00) + writer_table(False).segment(0x10)))
    plan = [(0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 1), (0, 0, 1, 0), (1, 63, 1, 0)]
    for start, end, high, low in plan:
        for c, blocks in enumerate(components):
            if start == 0:
                data = write_dc_bit(blocks, low) if high else write_dc(blocks, low)
            else:
                data = write_ac_bit(blocks, start, end, low) if high else write_ac(blocks, start, end, low)
            out += [segment(0xDA, bytes([1, c + 1, 0x00, start, end, high << 4 | low])), stuffed(data)]
    return b"".join([*out, b"\xff\xd9"])


class Image:
    """Coefficient arrays of a progressive file; `components` holds (h, v, quantiser table, blocks across, blocks down)."""

    def __init__(self, data: bytes):
        self.note, self.quantisers, tables, at = b"", {}, {}, 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        while True:
            marker, at = data[at + 1], at + 2
            if marker == 0xD9:
                break
            size = int.from_bytes(data[at : at + 2], "big")
            body, at = data[at + 2 : at + size], at + size
            if marker == 0xFE:
                self.note = body
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    q = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8)
                    self.quantisers[body[0] & 15], body = q.astype(np.float32), body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    counts = list(body[1:17])
                    n = sum(counts)
                    tables[body[0]], body = _table(tuple(counts), body[17 : 17 + n]), body[17 + n :]
            elif marker == 0xC2:
                _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
                named = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                self.hmax, self.vmax = max(x[1] for x in named), max(x[2] for x in named)
                self.across, self.down = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
                self.ids = [x[0] for x in named]
                self.components = [(h, v, q, self.across * h, self.down * v) for _, h, v, q in named]
                self.blocks = [np.zeros((w * d, 64), np.int32) for *_, w, d in self.components]
            elif marker == 0xDA:
                end = at
                while not (data[end] == 0xFF and data[end + 1] != 0):
                    end = data.index(b"\xff", end + (data[end] == 0xFF))
                self.scan(body, data[at:end].replace(b"\xff\x00", b"\xff"), tables)
                at = end
            elif 0xC0 <= marker <= 0xCF or marker == 0xDD:
                raise ValueError("only progressive Huffman files without restarts are read")

    def scan(self, head: bytes, data: bytes, tables: dict[int, Huffman]) -> None:
        n = head[0]
        parts = [(self.ids.index(head[1 + 2 * i]), head[2 + 2 * i]) for i in range(n)]
        start, end, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
        if n > 1:
            return self.interleaved(parts, data, tables, high, low)
        c, t = parts[0]
        h, v, _, across, down = self.components[c]
        w, d = -(-self.width * h // (8 * self.hmax)), -(-self.height * v // (8 * self.vmax))
        blocks = self.blocks[c]
        if (w, d) != (across, down):  # the last blocks of a component that the image doesn't reach
            at = (np.arange(d)[:, None] * across + np.arange(w)).ravel()
            blocks = blocks[at]
        if start == 0:
            read_dc_bit(data, blocks, low) if high else read_dc(data, blocks, low, tables[t >> 4])
        else:
            table = tables[0x10 | t & 15]
            read_ac_bit(data, blocks, start, end, low, table) if high else read_ac(data, blocks, start, end, low, table)
        if blocks is not self.blocks[c]:
            self.blocks[c][at] = blocks

    def interleaved(self, parts: list, data: bytes, tables: dict[int, Huffman], high: int, low: int) -> None:
        """A DC scan of several components, unit by unit."""
        bits, before = Bits(data), [0] * len(self.components)
        for unit in range(self.across * self.down):
            y, x = divmod(unit, self.across)
            for c, t in parts:
                h, v, _, across, _ = self.components[c]
                for i in range(h * v):
                    row = self.blocks[c][(y * v + i // h) * across + x * h + i % h]
                    if high:
                        row[0] |= bits.bit() << low
                    else:
                        before[c] += bits.value(bits.symbol(tables[t >> 4]))
                        row[0] = before[c] << low

    def rgb(self) -> np.ndarray:
        """height x width x 3, 8 bits: inverse transform, chroma upsampled by repetition, colours converted."""
        planes = []
        for (h, v, q, across, down), blocks in zip(self.components, self.blocks, strict=True):
            f = np.empty((len(blocks), 64), np.float32)
            f[:, zigzag()] = blocks * self.quantisers[q]
            c = cosines().astype(np.float32)
            p = c.T @ f.reshape(-1, 8, 8) @ c
            p = p.reshape(down, across, 8, 8).swapaxes(1, 2).reshape(down * 8, across * 8) + 128
            if (h, v) != (self.hmax, self.vmax):
                p = p.repeat(self.vmax // v, 0).repeat(self.hmax // h, 1)
            planes.append(p[: self.height, : self.width])
        y = planes[0]
        if len(planes) == 1:
            rgb = np.stack([y, y, y], -1)
        else:
            b, r = planes[1] - 128, planes[2] - 128
            rgb = np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], -1)
        return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


@cache
def _table(counts: tuple[int, ...], symbols: bytes) -> Huffman:
    return Huffman(list(counts), list(symbols))


def store(payload: bytes) -> bytes:
    """The file that keeps a payload (a positive multiple of 64 bytes)."""
    n = len(payload) // BLOCK
    units = -(-n // 6)
    across = -(-units // SIDE)
    down = -(-units // across)
    data = np.zeros((across * down * 6, BLOCK), np.int32)
    data[:n] = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    data += np.where(data < 128, -130, -126)
    y, c = across * down * 4, across * down
    return encode_image([data[:y], data[y : y + c], data[y + c :]], across * 16, down * 16, _NOTE + str(len(payload)).encode())


def load(image: Image) -> bytes:
    """The payload that a stored file keeps."""
    data = np.concatenate(image.blocks)
    data = data + np.where(data < 0, 130, 126)
    return data.astype(np.uint8).tobytes()[: int(image.note.removeprefix(_NOTE))]


def feature(rgb: np.ndarray) -> str:
    """Size, then mean and standard deviation of each colour."""
    flat = rgb.reshape(-1, 3).astype(np.float32)
    n, total, squares = len(flat), flat.sum(0, dtype=np.float64), np.einsum("ij,ij->j", flat, flat, dtype=np.float64)
    stats = [*total / n, *np.sqrt(np.maximum(0, squares / n - (total / n) ** 2))]
    return f"{rgb.shape[1]}x{rgb.shape[0]}:" + ",".join(f"{x:.3f}" for x in stats)


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8", "replace")
    return raw + bytes(-len(raw) % BLOCK or BLOCK * (not raw))


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, media (the file), width, height, rgb (the tensor's bytes, row by row)."""

    @F.pandas_udf("n_bytes long, media binary, width int, height int, rgb binary")
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                media = store(payload_of(t))
                rgb = Image(media).rgb()
                rows.append((len(t.encode()), media, rgb.shape[1], rgb.shape[0], rgb.tobytes()))
            yield pd.DataFrame(rows, columns=["n_bytes", "media", "width", "height", "rgb"])

    return docs.select(F.col(id_col), make(whole_text(text_col)).alias("m")).select(id_col, "m.*")


_OUT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What the query returns: every figure is taken from the stored file, read back."""

    @F.pandas_udf(_OUT)
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                media = store(payload_of(t))
                image = Image(media)
                back = load(image)
                rows.append((len(t.encode()), len(back), sha256(back).hexdigest(), crc32(back[-BLOCK:]), len(media), sha256(media).hexdigest(), feature(image.rgb())))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])

    return docs.select(F.col(id_col), digest(whole_text(text_col)).alias("m")).select(id_col, "m.*")
