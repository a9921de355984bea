"""Media columns: a progressive JPEG codec in numpy.

`decode` reads any 8-bit progressive (or baseline) Huffman JPEG: it accumulates the spectral-selection and
successive-approximation scans into one coefficient array a component, inverse-transforms, upsamples chroma by
repetition and gives an RGB tensor of full resolution. `encode_payload` stores bytes losslessly as quantised
coefficients (quantiser 1) of a colour picture, two thirds in its luma and a sixth in each chroma component of half
the resolution: the DC coefficient holds a byte by bit planes, each AC coefficient holds 256 + byte. Every symbol of
these scans has the same length, so files made here are parsed a scan at a time; other files go through the
bit-serial Huffman decoder.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, small_batches, utf8

UNIT, WIDE = 576, 16  # a unit of payload is nine blocks of 64 bytes; a picture is a column of 16 x 16 pixels, each four blocks of luma and one of each chroma
ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
_k = np.arange(8)
IDCT = (np.where(_k == 0, np.sqrt(0.5), 1.0)[:, None] * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16) / 2).astype(np.float32)
MOST_UNITS = 65_520 // WIDE * 6 // 9  # a JPEG has at most 65,535 rows; longer payloads become several frames in a row
AC_LOW = 4  # the first AC scan has the bits from here on; one refinement scan for each bit below


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, ident: int, symbols: dict[int, list[int]]) -> bytes:
    """symbols: by code length."""
    return _segment(0xC4, bytes([kind << 4 | ident, *(len(symbols.get(n, [])) for n in range(1, 17)), *(s for n in range(1, 17) for s in symbols.get(n, []))]))


def _scan(components: list[tuple[int, int, int]], ss: int, se: int, ah: int, al: int, bits: np.ndarray) -> bytes:
    """bits: 0 and 1, padded with ones to whole bytes, with a zero byte after each byte 255."""
    spare = -len(bits) % 8
    data = np.packbits(np.concatenate([bits, np.ones(spare, np.uint8)]) if spare else bits).tobytes()
    head = bytes([len(components), *(x for c, dc, ac in components for x in (c, dc << 4 | ac)), ss, se, ah << 4 | al])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def _frame(payload: np.ndarray) -> bytes:
    mcus = -(-len(payload) // (6 * 64))
    out = [b"\xff\xd8", _segment(0xDB, bytes([0, *[1] * 64])), _segment(0xC2, struct.pack(">BHHB", 8, WIDE * mcus, WIDE, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))]
    # one-bit codes: DC category 0; AC run 0 with category 8 - AC_LOW + 1; AC end-of-band runs
    out.append(_huffman(0, 0, {1: [0]}) + _huffman(1, 0, {1: [9 - AC_LOW]}))
    blocks = np.zeros((6 * mcus, 64), np.uint8)  # luma, then each chroma; the last ones may be spare
    blocks.ravel()[: len(payload)] = payload
    both, edges = [(1, 0, 0), (2, 0, 0), (3, 0, 0)], (0, 4 * mcus, 5 * mcus, 6 * mcus)
    out.append(_scan(both, 0, 0, 0, 8, np.zeros(6 * mcus, np.uint8)))
    dc = np.concatenate([blocks[: 4 * mcus, 0].reshape(mcus, 4), blocks[4 * mcus : 5 * mcus, :1], blocks[5 * mcus :, :1]], 1).ravel()
    for bit in range(7, -1, -1):
        out.append(_scan(both, 0, 0, bit + 1, bit, dc >> np.uint8(bit) & np.uint8(1)))
    width = 9 - AC_LOW
    first = np.zeros((6 * mcus, 63, 1 + width), np.uint8)
    first[:, :, 1] = 1  # the bit of 256
    for i in range(width - 1):
        first[:, :, 2 + i] = blocks[:, 1:] >> np.uint8(7 - i) & np.uint8(1)
    planes = [blocks[:, 1:] >> np.uint8(bit) & np.uint8(1) for bit in range(AC_LOW - 1, -1, -1)]
    runs = [end_runs(b - a) for a, b in zip(edges, edges[1:])]
    codes = {r << 4: i for i, r in enumerate(sorted({r for x in runs for r, _, _ in x}))}
    out.append(_huffman(1, 1, {4: list(codes)}))
    for c, own in enumerate(runs):
        begin, end = edges[c], edges[c + 1]
        out.append(_scan([(c + 1, 0, 0)], 1, 63, 0, AC_LOW, first[begin:end].ravel()))
        for bit, plane in zip(range(AC_LOW - 1, -1, -1), planes):
            parts, at = [], begin
            for r, extra, n in own:
                parts += [_bits(codes[r << 4], 4), _bits(extra, r), plane[at : at + n].ravel()]
                at += n
            out.append(_scan([(c + 1, 0, 1)], 1, 63, bit + 1, bit, np.concatenate(parts)))
    return b"".join([*out, b"\xff\xd9"])


def _bits(x: int, n: int) -> np.ndarray:
    return np.array([x >> (n - 1 - i) & 1 for i in range(n)], np.uint8)


def end_runs(blocks: int) -> list[tuple[int, int, int]]:
    """End-of-band runs that cover so many blocks: (exponent, extra bits, blocks)."""
    out = []
    while blocks:
        n = min(blocks, 32_767)
        r = n.bit_length() - 1
        out.append((r, n - (1 << r), n))
        blocks -= n
    return out


def encode_payload(payload: bytes) -> bytes:
    """Frames, one after another, that hold the payload (a positive multiple of UNIT bytes)."""
    x = np.frombuffer(payload, np.uint8)
    return b"".join(_frame(x[a : a + MOST_UNITS * UNIT]) for a in range(0, len(x), MOST_UNITS * UNIT))


class _Huffman:
    def __init__(self, counts: bytes, symbols: bytes):
        self.codes, code, k = {}, 0, 0
        for n, c in enumerate(counts, 1):
            for _ in range(c):
                self.codes[n, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        lengths = {n for n, _ in self.codes}
        self.fixed = lengths.pop() if len(lengths) == 1 else 0  # the length of all codes, if they have one
        self.symbols = list(symbols)


class _Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def take(self, n: int) -> int:
        x = 0
        for b in self.bits[self.at : self.at + n].tolist():
            x = x << 1 | b
        self.at += n
        return x

    def symbol(self, table: _Huffman) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | int(self.bits[self.at])
            self.at += 1
            if (n, code) in table.codes:
                return table.codes[n, code]
        raise ValueError("no such Huffman code")

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x if not n or x >> (n - 1) else x - (1 << n) + 1


class Component:
    def __init__(self, ident: int, h: int, v: int, q: int):
        self.ident, self.h, self.v, self.q = ident, h, v, q
        self.wide = self.high = self.all_wide = self.all_high = 0
        self.coefficients = np.zeros((0, 64), np.int32)  # in zigzag order, blocks by rows, padded to whole MCUs


def scans(data: bytes):
    """Split into (marker, body, entropy-coded data); the data's stuffed zeros and restart markers are taken out by the caller."""
    at = 2
    while at < len(data):
        marker = data[at + 1]
        if marker == 0xD9:
            return
        n = struct.unpack_from(">H", data, at + 2)[0]
        body, at, end = data[at + 4 : at + 2 + n], at + 2 + n, at + 2 + n
        if marker == 0xDA:
            while True:
                end = data.index(b"\xff", end)
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                else:
                    break
        yield marker, body, data[at:end]
        at = end


def coefficients(data: bytes) -> tuple[int, int, list[Component], dict[int, np.ndarray]]:
    """Height, width, components with all scans accumulated, and the quantisers in zigzag order."""
    quant: dict[int, np.ndarray] = {}
    tables: dict[tuple[int, int], _Huffman] = {}
    parts: list[Component] = []
    high = wide = restart = 0
    progressive = True
    for marker, body, coded in scans(data):
        if marker == 0xDB:
            at = 0
            while at < len(body):
                two, k = body[at] >> 4, body[at] & 15
                quant[k] = np.frombuffer(body, ">u2" if two else np.uint8, 64, at + 1).astype(np.int32)
                at += 129 if two else 65
        elif marker in (0xC0, 0xC1, 0xC2):
            progressive = marker == 0xC2
            _, high, wide, n = struct.unpack_from(">BHHB", body)
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            hm, vm = max(p.h for p in parts), max(p.v for p in parts)
            for p in parts:
                p.wide, p.high = -(-(-(-wide * p.h // hm)) // 8), -(-(-(-high * p.v // vm)) // 8)
                p.all_wide, p.all_high = -(-wide // (8 * hm)) * p.h, -(-high // (8 * vm)) * p.v
                p.coefficients = np.zeros((p.all_high * p.all_wide, 64), np.int32)
        elif marker == 0xC4:
            at = 0
            while at < len(body):
                n = sum(body[at + 1 : at + 17])
                tables[body[at] >> 4, body[at] & 15] = _Huffman(body[at + 1 : at + 17], body[at + 17 : at + 17 + n])
                at += 17 + n
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            n = body[0]
            own = [(next(p for p in parts if p.ident == body[1 + 2 * i]), tables.get((0, body[2 + 2 * i] >> 4)), tables.get((1, body[2 + 2 * i] & 15))) for i in range(n)]
            ss, se, a = body[1 + 2 * n : 4 + 2 * n]
            ah, al = a >> 4, a & 15
            if not progressive:
                ss, se, ah, al = 0, 63, 0, 0
            if restart or not progressive or not (_whole(own[0], ss, se, ah, al, coded) if n == 1 else _whole_column(own, ss, ah, al, coded)):
                _serial(own, ss, se, ah, al, coded, restart, progressive)
    return high, wide, parts, quant


def _grid(p: Component) -> np.ndarray:
    """Rows of the coefficient array that a scan of this component alone goes through."""
    return (np.arange(p.high)[:, None] * p.all_wide + np.arange(p.wide)).ravel()


def _whole(own, ss: int, se: int, ah: int, al: int, coded: bytes) -> bool:
    """Parse a scan whose codes all have one length and whose blocks are alike in one go; False if it isn't such a scan."""
    p, dc, ac = own
    n = p.wide * p.high
    bits = np.unpackbits(np.frombuffer(coded.replace(b"\xff\x00", b"\xff"), np.uint8))
    plain = p.wide == p.all_wide
    rows = slice(0, n) if plain else _grid(p)
    if ss == 0 and se == 0:
        if ah:
            if len(bits) < n:
                return False
            p.coefficients[rows, 0] |= bits[:n].astype(np.int32) << al
            return True
        # one symbol: every difference has category 0
        return dc is not None and dc.symbols == [0] and len(bits) >= n * dc.fixed and not bits[: n * dc.fixed].any()
    k = se - ss + 1
    if not ah:
        if ac is None or len(ac.symbols) != 1 or not 0 < ac.symbols[0] < 16:
            return False
        size = ac.symbols[0]
        each = ac.fixed + size
        if len(bits) < n * k * each:
            return False
        bits = bits[: n * k * each].reshape(n, k, each)
        if bits[:, :, : ac.fixed].any() or not bits[:, :, ac.fixed].all():  # the code, and values that are all positive
            return False
        low = np.zeros((n, k), np.int32)
        for i in range(size):
            low = low << 1 | bits[:, :, ac.fixed + i]
        p.coefficients[rows, ss : se + 1] = low << al
        return True
    if ac is None or not ac.fixed or any(s & 15 or s >> 4 == 15 for s in ac.symbols) or not (band := p.coefficients[rows, ss : se + 1]).all():
        return False
    at = done = 0
    planes = []
    while done < n:  # end-of-band runs, each followed by one correction bit for each coefficient
        r = ac.symbols[int("".join(map(str, bits[at : at + ac.fixed].tolist())), 2)] >> 4
        at += ac.fixed
        run = (1 << r) + (int("".join(map(str, bits[at : at + r].tolist())), 2) if r else 0)
        at += r
        planes.append(bits[at : at + run * k])
        at, done = at + run * k, done + run
    plane = (planes[0] if len(planes) == 1 else np.concatenate(planes)).reshape(n, k).astype(np.int32) << al
    p.coefficients[rows, ss : se + 1] = band + np.where(band > 0, plane, -plane)
    return True


def _whole_column(own, ss: int, ah: int, al: int, coded: bytes) -> bool:
    """As _whole, for a scan of DC bits of several components in a picture one unit wide, where each component's blocks stand in its coefficient array as they come."""
    if ss or any(p.all_wide != p.h for p, _, _ in own):
        return False
    each = [p.h * p.v for p, _, _ in own]
    mcus, k = own[0][0].all_high // own[0][0].v, sum(each)
    bits = np.unpackbits(np.frombuffer(coded.replace(b"\xff\x00", b"\xff"), np.uint8))[: mcus * k]
    if len(bits) < mcus * k:
        return False
    if not ah:  # one symbol of one bit: every difference has category 0
        return all(dc is not None and dc.symbols == [0] and dc.fixed == 1 for _, dc, _ in own) and not bits.any()
    bits, at = bits.reshape(mcus, k).astype(np.int32) << al, 0
    for (p, _, _), n in zip(own, each):
        p.coefficients[:, 0] |= bits[:, at : at + n].ravel()
        at += n
    return True


def _serial(own, ss: int, se: int, ah: int, al: int, coded: bytes, restart: int, progressive: bool) -> None:
    """The general decoder, a bit at a time."""
    if len(own) == 1:
        units = [[(0, int(r))] for r in _grid(own[0][0])]
    else:
        wide, high = own[0][0].all_wide // own[0][0].h, own[0][0].all_high // own[0][0].v
        units = [[(i, (y * p.v + v) * p.all_wide + x * p.h + h) for i, (p, _, _) in enumerate(own) for v in range(p.v) for h in range(p.h)] for y in range(high) for x in range(wide)]
    runs, at = [], 0
    while at < len(coded):  # between restart markers
        end = at
        while end < len(coded) and not (coded[end] == 0xFF and end + 1 < len(coded) and 0xD0 <= coded[end + 1] <= 0xD7):
            end += 1
        runs.append(_Bits(coded[at:end].replace(b"\xff\x00", b"\xff")))
        at = end + 2
    for k in range(0, len(units), restart or len(units)):
        bits, last, left = runs[k // (restart or len(units))], [0] * len(own), 0
        for unit in units[k : k + (restart or len(units))]:
            for i, row in unit:
                p, dc, ac = own[i]
                block = p.coefficients[row]
                if not progressive or ss == 0:
                    if ah:
                        block[0] |= bits.take(1) << al
                    else:
                        last[i] += bits.signed(bits.symbol(dc))
                        block[0] = last[i] * (1 << al)
                if not progressive:
                    _first(bits, ac, block, 1, 63, 0, 0)
                elif ss and not ah:
                    left = _first(bits, ac, block, ss, se, al, left)
                elif ss:
                    left = _refine(bits, ac, block, ss, se, al, left)


def _first(bits: _Bits, ac: _Huffman, block: np.ndarray, ss: int, se: int, al: int, left: int) -> int:
    if left:
        return left - 1
    k = ss
    while k <= se:
        r, s = divmod(bits.symbol(ac), 16)
        if s:
            k += r
            block[k] = bits.signed(s) * (1 << al)
        elif r == 15:
            k += 15
        else:
            return (1 << r) - 1 + bits.take(r)
        k += 1
    return 0


def _refine(bits: _Bits, ac: _Huffman, block: np.ndarray, ss: int, se: int, al: int, left: int) -> int:
    def correct(k: int) -> None:
        if bits.take(1):
            block[k] += (1 if block[k] > 0 else -1) << al

    k = ss
    if not left:
        while k <= se:
            r, s = divmod(bits.symbol(ac), 16)
            new = 0
            if s:
                new = 1 if bits.take(1) else -1
            elif r < 15:
                left = (1 << r) + bits.take(r)
                break
            while k <= se:
                if block[k]:
                    correct(k)
                elif not r:
                    break
                else:
                    r -= 1
                k += 1
            if new and k <= se:
                block[k] = new << al
            k += 1
    if left:
        for j in range(k, se + 1):
            if block[j]:
                correct(j)
        return left - 1
    return 0


def plane(p: Component, quant: np.ndarray) -> np.ndarray:
    """The component's samples: dequantised, inverse-transformed, level-shifted, clipped."""
    x = np.zeros((len(p.coefficients), 64), np.float32)
    x[:, ZIGZAG] = p.coefficients * quant
    x = IDCT.T @ x.reshape(-1, 8, 8) @ IDCT
    x = x.reshape(p.all_high, p.all_wide, 8, 8).transpose(0, 2, 1, 3).reshape(p.all_high * 8, p.all_wide * 8)
    return np.clip(np.rint(x + np.float32(128)), 0, 255).astype(np.uint8)


def rgb(high: int, wide: int, parts: list[Component], quant: dict[int, np.ndarray]) -> np.ndarray:
    """Full-resolution (height, width, 3) tensor; a single component gives grey, chroma is upsampled by repetition."""
    hm, vm = max(p.h for p in parts), max(p.v for p in parts)
    planes = []
    for p in parts:
        x = plane(p, quant[p.q])
        x = x.repeat(vm // p.v, 0) if vm > p.v else x
        x = x.repeat(hm // p.h, 1) if hm > p.h else x
        planes.append(x[:high, :wide])
    if len(planes) == 1:
        return np.stack([planes[0]] * 3, -1)
    y, cb, cr = planes
    if (cb == 128).all() and (cr == 128).all():
        return np.stack([y] * 3, -1)
    y, cb, cr = y.astype(np.float32), cb - np.float32(128), cr - np.float32(128)
    out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    return rgb(*coefficients(data))


def frames(data: bytes):
    """The JPEG files that follow one another in data."""
    at = 0
    while at < len(data):
        end = data.index(b"\xff\xd9", at) + 2  # stuffing keeps FF D9 out of coded data, and tables here hold no FF
        yield data[at:end]
        at = end


def read_payload(media: bytes) -> tuple[bytes, list[np.ndarray]]:
    """The payload that encode_payload stored, and each frame's RGB tensor."""
    payload, tensors = [], []
    for f in frames(media):
        high, wide, parts, quant = coefficients(f)
        blocks = np.concatenate([p.coefficients for p in parts])
        payload.append((blocks & 255).astype(np.uint8).tobytes()[: blocks.size // UNIT * UNIT])
        tensors.append(rgb(high, wide, parts, quant))
    return b"".join(payload), tensors


def decode_column(df: DataFrame, key: str, media: str) -> DataFrame:
    """(key, height, width, rgb binary, error) for a binary column of JPEG files; the tensor's bytes go by rows.

    Null media gives nulls; bytes that are no JPEG give nulls and the error's text. Rows are read one by one.
    """
    small_batches(df.sparkSession, 64)
    base = df.select(key, media)

    def each(b: pa.RecordBatch) -> dict:
        out: dict = {key: b.column(0), "height": [], "width": [], "rgb": [], "error": []}
        for x in b.column(1).to_pylist():
            try:
                t = None if x is None else decode(x)
                row = (None, None, None, None) if t is None else (t.shape[0], t.shape[1], t.tobytes(), None)
            except (ValueError, IndexError, KeyError, StopIteration, struct.error) as e:
                row = (None, None, None, f"{type(e).__name__}: {e}")
            for name, v in zip(("height", "width", "rgb", "error"), row):
                out[name].append(v)
        return out

    return map_arrow(base, each, f"`{key}` {base.schema[0].dataType.simpleString()}, height int, width int, rgb binary, error string")


def store_tensors(df: DataFrame, key: str, media: str, path: str) -> DataFrame:
    """decode_column's rows written as Parquet to a new folder and read again: (key, height, width, rgb binary, error)."""
    out = decode_column(df, key, media)
    out.write.parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path)


def pad(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text (null: empty), padded with bytes 255 to a positive multiple of UNIT, as progressive JPEG."""
    small_batches(docs.sparkSession)

    def each(b: pa.RecordBatch) -> dict:
        texts = utf8(b.column(1))
        return {"doc_id": b.column(0), "n_bytes": [len(t) for t in texts], "media": [encode_payload(pad(t)) for t in texts]}

    return map_arrow(docs.select("doc_id", "text"), each, "doc_id long, n_bytes long, media binary")


def read_back(stored: DataFrame) -> DataFrame:
    """From store_texts' rows: payload digests, media digests and a feature (mean and standard deviation of the RGB tensor's luminance)."""
    small_batches(stored.sparkSession)

    def each(b: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": b.column(0), "n_bytes": b.column(1)} | {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for media in b.column(2).to_pylist():
            payload, tensors = read_payload(media)
            n = sum(t.size for t in tensors)
            s = sum(int(t.sum(dtype=np.int64)) for t in tensors)
            q = sum(int(np.einsum("i,i->", v := t.ravel().astype(np.float32), v, dtype=np.float64)) for t in tensors)
            for k, v in zip(list(out)[2:], (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{s / n:.4f},{max(q / n - (s / n) ** 2, 0) ** 0.5:.4f}")):
                out[k].append(v)
        return out

    return map_arrow(stored, each, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
