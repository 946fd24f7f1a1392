"""Media columns: baseline JPEG read in numpy down to DC-only luminance thumbnails.

``thumbnails`` parses markers and Huffman-decodes the scans of many JPEGs at once: restart intervals are independent,
so all intervals of a batch advance together, a symbol a step. AC coefficients are skipped, DC coefficients become
luminance at an eighth of the size. ``encode`` writes the matching form: each sample is one 8x8 block that has a DC
coefficient only, quantised by 8, so the thumbnail of what is stored gives back the samples exactly.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow, batches, column, utf8

#: Samples in a row of a stored image, and rows at most (a JPEG has at most 65,535 lines of pixels).
WIDTH, ROWS = 64, 8191
#: Lengths of the Huffman codes of DC categories 0 to 11.
_DC_LENGTHS = (2, 3, 3, 3, 3, 3, 4, 5, 6, 7, 8, 9)


def _canonical(symbols_by_length: list[list[int]]) -> dict[int, tuple[int, int]]:
    code, out = 0, {}
    for n, symbols in enumerate(symbols_by_length, 1):
        for s in symbols:
            out[s] = (code, n)
            code += 1
        code <<= 1
    return out


def _dht(kind: int, symbols_by_length: list[list[int]]) -> bytes:
    body = bytes([kind, *map(len, symbols_by_length)]) + bytes(s for x in symbols_by_length for s in x)
    return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


_DC_SYMBOLS = [[s for s, n in enumerate(_DC_LENGTHS) if n == length] for length in range(1, 17)]
_AC_SYMBOLS = [[0], *([] for _ in range(15))]
_DC_CODES = _canonical(_DC_SYMBOLS)


def _head(rows: int) -> bytes:
    quant = bytes([8]) + bytes([1]) * 63
    return b"".join((
        b"\xff\xd8", b"\xff\xdb", struct.pack(">HB", 67, 0), quant,
        b"\xff\xc0", struct.pack(">HBHHBBBB", 11, 8, rows * 8, WIDTH * 8, 1, 1, 0x11, 0),
        _dht(0x00, _DC_SYMBOLS), _dht(0x10, _AC_SYMBOLS),
        b"\xff\xdd", struct.pack(">HH", 4, WIDTH), b"\xff\xda", struct.pack(">HBBBBBB", 8, 1, 1, 0, 0, 63, 0)))


_CATEGORY = np.zeros(512, np.int64)
for _d in range(-255, 256):
    _CATEGORY[_d + 256] = abs(_d).bit_length()
_SYMBOL = np.zeros(512, np.int64)
_SYMBOL_BITS = np.zeros(512, np.int64)
for _d in range(-255, 256):
    _c = abs(_d).bit_length()
    _code, _n = _DC_CODES[_c]
    # DC code, the difference's bits, and the one-bit end of block
    _SYMBOL[_d + 256] = ((_code << _c | (_d if _d >= 0 else _d + (1 << _c) - 1)) << 1)
    _SYMBOL_BITS[_d + 256] = _n + _c + 1


def encode(samples: list[np.ndarray]) -> list[bytes]:
    """JPEG streams of arrays of bytes whose sizes are positive multiples of 64; beyond ROWS rows, several in a row."""
    frames = [(i, at) for i, x in enumerate(samples) for at in range(0, len(x), WIDTH * ROWS)]
    parts = [samples[i][at : at + WIDTH * ROWS] for i, at in frames]
    rows = np.array([len(p) // WIDTH for p in parts])
    v = np.concatenate(parts).astype(np.int64).reshape(-1, WIDTH) - 128
    diff = v.copy()
    diff[:, 1:] -= v[:, :-1]
    diff += 256
    bits = np.empty((len(v), WIDTH + 1), np.int64)
    code = np.empty((len(v), WIDTH + 1), np.int64)
    bits[:, :-1], code[:, :-1] = _SYMBOL_BITS[diff], _SYMBOL[diff]
    used = bits[:, :-1].sum(axis=1)
    pad = -used % 8
    bits[:, -1], code[:, -1] = pad, (1 << pad) - 1  # each interval ends on a byte, filled with ones
    row_bytes = (used + pad) // 8
    flat_bits, flat = bits.ravel(), code.ravel()
    at = np.cumsum(flat_bits) - flat_bits
    value = flat << (32 - (at & 15) - flat_bits)
    n16 = int(row_bytes.sum() * 8 + 15) // 16 + 2
    words = np.bincount(at >> 4, value >> 16, n16) + np.bincount((at >> 4) + 1, value & 0xFFFF, n16)
    stream = words.astype(">u2").view(np.uint8)[: int(row_bytes.sum())]
    row_of = np.repeat(np.arange(len(v)), row_bytes)
    stuffed = (stream == 0xFF).astype(np.int64)
    place = np.arange(len(stream)) + np.cumsum(stuffed) - stuffed + 2 * row_of
    out = np.zeros(len(stream) + int(stuffed.sum()) + 2 * len(v), np.uint8)
    out[place] = stream
    ends = np.cumsum(row_bytes) + np.r_[np.cumsum(stuffed), 0][np.cumsum(row_bytes) - 1] + 2 * np.arange(len(v))
    first_row = np.cumsum(rows) - rows
    within = np.arange(len(v)) - np.repeat(first_row, rows)
    out[ends], out[ends + 1] = 0xFF, 0xD0 + within % 8
    last = first_row + rows - 1
    begins = np.r_[0, ends[last][:-1] + 2]
    stored = [b""] * len(samples)
    for k, (i, _) in enumerate(frames):
        stored[i] += _head(int(rows[k])) + out[begins[k] : ends[last[k]]].tobytes() + b"\xff\xd9"
    return stored


@dataclass(frozen=True)
class Frame:
    width: int
    height: int
    components: tuple[tuple[int, int, int, bytes, bytes], ...]  # id, horizontal and vertical factor, DC and AC table
    quant: int
    restart: int
    scan: tuple[int, int]


def parse(data: bytes) -> list[Frame]:
    """The images of a stream of baseline JPEGs, one scan each."""
    frames, at, n = [], 0, len(data)
    quant: dict[int, int] = {}
    tables: dict[int, bytes] = {}
    restart, size, comps = 0, (0, 0), []
    while at < n:
        if data[at] != 0xFF:
            raise ValueError(f"no marker at {at}")
        mark = data[at + 1]
        at += 2
        if mark == 0xD8:
            quant, tables, restart, comps = {}, {}, 0, []
            continue
        if mark == 0xD9 or mark == 0xFF:
            at -= mark == 0xFF
            continue
        length = struct.unpack(">H", data[at : at + 2])[0]
        body = data[at + 2 : at + length]
        at += length
        if mark == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = struct.unpack(">H", body[k + 1 : k + 3])[0] if wide else body[k + 1]
                k += 129 if wide else 65
        elif mark == 0xC4:
            k = 0
            while k < len(body):
                m = 17 + sum(body[k + 1 : k + 17])
                tables[body[k]] = body[k + 1 : k + m]
                k += m
        elif mark == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif mark in (0xC0, 0xC1):
            size = struct.unpack(">HH", body[1:5])
            comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif mark == 0xDA:
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            end = at
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= n:
                    raise ValueError("a scan without an end")
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                    continue
                break
            parts = tuple((c, h, v, tables[chosen[c] >> 4], tables[0x10 | chosen[c] & 15]) for c, h, v, _ in comps if c in chosen)
            if len(parts) != len(comps):
                raise ValueError("scans of single components are not read")
            frames.append(Frame(size[1], size[0], parts, quant[comps[0][3]], restart, (at, end)))
            at = end
        elif 0xC0 < mark <= 0xCF and mark not in (0xC8, 0xCC):
            raise ValueError(f"not a baseline image: SOF{mark - 0xC0}")
    return frames


_LOOKUPS: dict[bytes, np.ndarray] = {}


def _lookup(table: bytes) -> np.ndarray:
    """By the next 16 bits: length of the code << 8 | symbol; 0 where there is no such code."""
    if table not in _LOOKUPS:
        out, at, symbols = np.zeros(1 << 16, np.int64), 0, []
        for n in range(16):
            symbols.append(list(table[16 + at : 16 + at + table[n]]))
            at += table[n]
        for s, (code, n) in _canonical(symbols).items():
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
        _LOOKUPS[table] = out
    return _LOOKUPS[table]


def _intervals(scans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all scans without stuffing and markers; where each interval starts; the scan of each interval."""
    raw = np.frombuffer(b"".join(scans), np.uint8)
    edge = np.cumsum([0, *map(len, scans)])
    ff = raw[:-1] == 0xFF
    follow = raw[1:]
    drop = np.zeros(len(raw), bool)
    drop[1:] |= ff & (follow == 0)
    mark = np.flatnonzero(ff & (follow >= 0xD0) & (follow <= 0xD7))
    drop[mark] = True
    drop[mark + 1] = True
    kept = raw[~drop]
    shift = np.cumsum(drop)
    starts = np.concatenate([edge[:-1], mark + 2])
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    scan_of = np.searchsorted(edge, starts, "right") - 1
    return kept, starts - np.where(starts > 0, shift[np.maximum(starts - 1, 0)], 0), scan_of


def thumbnails(images: list[bytes]) -> list[list[np.ndarray]]:
    """For each stream, its images' luminance at an eighth of the size (uint8), from DC coefficients alone."""
    out: list[list] = [[] for _ in images]
    groups: dict[tuple, list] = {}
    for i, data in enumerate(images):
        for f in parse(data):
            out[i].append(None)
            groups.setdefault((f.components, f.restart, f.quant), []).append((i, len(out[i]) - 1, f, data[f.scan[0] : f.scan[1]]))
    for (components, restart, quant), members in groups.items():
        for (i, k, *_), image in zip(members, _decode(components, restart, quant, [m[2] for m in members], [m[3] for m in members])):
            out[i][k] = image
    return out


def _decode(components, restart: int, quant: int, frames: list[Frame], scans: list[bytes]) -> list[np.ndarray]:
    hmax, vmax = max(c[1] for c in components), max(c[2] for c in components)
    single = len(components) == 1
    plan = [(0, 0, 0)] if single else [(j, v, h) for j, c in enumerate(components) for v in range(c[2]) for h in range(c[1])]
    step = 8 if single else 8 * hmax, 8 if single else 8 * vmax
    across = np.array([-(-f.width // step[0]) for f in frames])
    mcus = across * np.array([-(-f.height // step[1]) for f in frames])
    kept, starts, scan_of = _intervals(scans)
    nth = np.arange(len(starts)) - np.searchsorted(scan_of, scan_of)
    todo = np.minimum(mcus[scan_of] - nth * restart, restart) if restart else mcus[scan_of]
    b = np.concatenate([kept, np.full(8, 0xFF, np.uint8)]).astype(np.int64)
    four = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
    top = len(four) - 1
    pos = starts * 8
    per = sum(1 for j, *_ in plan if j == 0)
    most = int(todo.max(initial=0))
    dc = np.zeros((len(starts), most, per), np.int64)
    pred = np.zeros((len(components), len(starts)), np.int64)
    lanes = np.arange(len(starts))
    for m in range(most):
        live = lanes if todo.min() > m else np.flatnonzero(todo > m)
        seen = 0
        for j, _, _ in plan:
            dc_table, ac_table = _lookup(components[j][3]), _lookup(components[j][4])
            p = pos[live]
            e = dc_table[four[np.minimum(p >> 3, top)] >> (16 - (p & 7)) & 0xFFFF]
            if not e.all():
                raise ValueError("a code that the table lacks")
            p += e >> 8
            cat = e & 255
            bits = four[np.minimum(p >> 3, top)] >> (16 - (p & 7)) & 0xFFFF
            val = bits >> (16 - cat)
            val = np.where(cat > 0, np.where(val < (1 << cat >> 1), val - (1 << cat) + 1, val), 0)
            p += cat
            pred[j, live] += val
            if j == 0:
                dc[live, m, seen] = pred[0, live]
                seen += 1
            k = np.ones(len(live), np.int64)
            open_ = np.arange(len(live))
            while len(open_):
                q = p[open_]
                e = ac_table[four[np.minimum(q >> 3, top)] >> (16 - (q & 7)) & 0xFFFF]
                if not e.all():
                    raise ValueError("a code that the table lacks")
                s = e & 255
                p[open_] = q + (e >> 8) + (s & 15)
                k[open_] = np.where(s == 0, 64, k[open_] + (s >> 4) + 1)
                open_ = open_[k[open_] < 64]
            pos[live] = p
    light = np.clip((dc * quant + 4) // 8 + 128, 0, 255).astype(np.uint8)
    first = np.searchsorted(scan_of, np.arange(len(frames)))
    count = np.bincount(scan_of, minlength=len(frames))
    h, v = (1, 1) if single else components[0][1:3]
    result = []
    for i, f in enumerate(frames):
        blocks = light[first[i] : first[i] + count[i]].reshape(-1, per)
        if restart:
            keep = (np.arange(most)[None, :] < todo[first[i] : first[i] + count[i], None]).ravel()
            blocks = blocks[keep]
        blocks = blocks[: mcus[i]].reshape(-1, across[i], v, h).transpose(0, 2, 1, 3).reshape(-1, across[i] * h)
        result.append(blocks[: -(-f.height * v // (8 * vmax)) if not single else -(-f.height // 8), : -(-f.width * h // (8 * hmax)) if not single else -(-f.width // 8)])
    return result


def thumbnail_hash(image: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 grid are lighter than the mean of the cells."""
    def edges(n):
        a = np.arange(8) * n // 8
        return a, np.maximum((np.arange(8) + 1) * n // 8, a + 1)

    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1), np.int64)
    total[1:, 1:] = image.astype(np.int64).cumsum(axis=0).cumsum(axis=1)
    (r0, r1), (c0, c1) = edges(image.shape[0]), edges(image.shape[1])
    cells = (total[r1][:, c1] - total[r0][:, c1] - total[r1][:, c0] + total[r0][:, c0]) / ((r1 - r0)[:, None] * (c1 - c0)[None, :])
    return np.packbits(cells > cells.mean()).tobytes().hex()


def features(images: list[bytes]) -> list[tuple[int, int, np.ndarray, str]]:
    """Per stream: width and height in pixels, the thumbnail (several images one above the other), and its hash."""
    out = []
    for found in thumbnails(images):
        image = found[0] if len(found) == 1 else np.vstack(found)
        out.append((image.shape[1] * 8, image.shape[0] * 8, image, thumbnail_hash(image)))
    return out


def _stored_long(x: np.ndarray) -> tuple[bytes, tuple[int, int, np.ndarray, str]]:
    """``encode`` and ``features`` of samples of several images, an image at a time, so that memory follows one image."""
    forms = [encode([x[at : at + ROWS * WIDTH]])[0] for at in range(0, len(x), ROWS * WIDTH)]
    image = np.vstack([features([f])[0][2] for f in forms])
    return b"".join(forms), (image.shape[1] * 8, image.shape[0] * 8, image, thumbnail_hash(image))


def store(docs: DataFrame, media: bool = True) -> DataFrame:
    """Per row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, width, height,
    feature, and the stored image itself as media unless that is not wanted.

    A text's UTF-8 bytes, filled up with zeros to a positive multiple of 64, are stored as the samples of a JPEG, which
    is then read back; what describes the payload comes from what was read.

    Defined cases: a null text is an empty one: one row of 64 zeros; null doc_ids and repeated rows are rows like
    others; a text of over 524,224 bytes becomes several images in one stream; an empty table gives an empty one;
    further columns are ignored.
    """
    names = ["n_bytes", "payload_bytes", "tail_crc32", "media_bytes", "width", "height", "payload_sha256", "media_sha256", "feature"] + ["media"] * media

    def run(parts):
        for whole in parts:
            for batch in batches(whole, most=384 << 10):
                data, offs = utf8(column(batch, "text"))
                padded = []
                for a, b in zip(offs[:-1], offs[1:]):
                    x = np.zeros(max(1, -(-int(b - a) // WIDTH)) * WIDTH, np.uint8)
                    x[: b - a] = data[a:b]
                    padded.append(x)
                if len(padded) == 1 and len(padded[0]) > ROWS * WIDTH:
                    form, described = _stored_long(padded[0])
                    stored, found = [form], [described]
                else:
                    stored = encode(padded)
                    found = features(stored)
                cols: list[list] = [[] for _ in names]
                for n, form, (w, h, image, mark) in zip(np.diff(offs), stored, found):
                    payload = image.tobytes()
                    row = (int(n), len(payload), zlib.crc32(payload[-64:]), len(form), w, h, hashlib.sha256(payload).hexdigest(), hashlib.sha256(form).hexdigest(), f"{w}x{h}:{mark}", form)
                    for c, x in zip(cols, row):
                        c.append(x)
                kinds = [pa.int64()] * 6 + [pa.string()] * 3 + [pa.binary()] * media
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    types = ["long"] * 6 + ["string"] * 3 + ["binary"] * media
    return arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, " + ", ".join(f"{n} {t}" for n, t in zip(names, types)))
