"""Reading and writing of TIFF rasters in numpy: the subset that cloud-optimised GeoTIFFs use.

Classic and big TIFF of both byte orders; strips and tiles; chunky and planar; no
compression, deflate and LZW; no or horizontal prediction; integers of 8 to 32 bits
and floats. Only the first directory (full resolution) is read.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

# Tag numbers and field types of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 270, 273, 277, 278, 279
PLANAR, DATETIME, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 284, 306, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, GDAL_METADATA, GDAL_NODATA = 33550, 33922, 34264, 34735, 42112, 42113
PHOTOMETRIC = 262
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946


class TiffError(ValueError):
    """Not a TIFF, or one outside the supported subset."""


@dataclass(frozen=True)
class Header:
    width: int
    height: int
    bands: int
    dtype: str
    tags: dict
    order: str

    @property
    def block(self) -> tuple[int, int]:
        """Height and width of a block."""
        if TILE_WIDTH in self.tags:
            return self.tags[TILE_HEIGHT][0], self.tags[TILE_WIDTH][0]
        return min(self.tags.get(ROWS_PER_STRIP, (self.height,))[0], self.height), self.width

    @property
    def planar(self) -> bool:
        return self.tags.get(PLANAR, (1,))[0] == 2 and self.bands > 1

    @property
    def affine(self) -> tuple[float, float, float, float, float, float] | None:
        """(a, b, c, d, e, f): x = a*col + b*row + c, y = d*col + e*row + f."""
        if TRANSFORM in self.tags:
            m = self.tags[TRANSFORM]
            return m[0], m[1], m[3], m[4], m[5], m[7]
        if PIXEL_SCALE in self.tags and TIEPOINT in self.tags:
            sx, sy = self.tags[PIXEL_SCALE][:2]
            i, j, _, x, y = self.tags[TIEPOINT][:5]
            return sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy
        return None

    @property
    def bounds(self) -> tuple[float, float, float, float] | None:
        if self.affine is None:
            return None
        a, b, c, d, e, f = self.affine
        xs = [c, c + a * self.width, c + b * self.height, c + a * self.width + b * self.height]
        ys = [f, f + d * self.width, f + e * self.height, f + d * self.width + e * self.height]
        return min(xs), min(ys), max(xs), max(ys)

    @property
    def epsg(self) -> int | None:
        keys = self.tags.get(GEO_KEYS, ())
        entries = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        code = entries.get(3072) or entries.get(2048)  # projected, geographic
        return code if code and code != 32767 else None

    @property
    def nodata(self) -> float | None:
        text = self.tags.get(GDAL_NODATA)
        try:
            return float(text) if text else None
        except ValueError:
            return None

    @property
    def descriptions(self) -> list[str]:
        """Names of the bands from the metadata item "DESCRIPTION" of each sample; empty if not all have one."""
        import re

        found = dict(re.findall(r'<Item name="DESCRIPTION" sample="(\d+)"[^>]*>([^<]*)<', self.tags.get(GDAL_METADATA, "")))
        names = [found.get(str(i), "") for i in range(self.bands)]
        return names if all(names) else []


def _at(form: str, raw, place: int) -> tuple:
    """Numbers at a place of bytes, or of a file read by ranges."""
    return struct.unpack(form, raw[place : place + struct.calcsize(form)])


def read_header(raw: bytes) -> Header:
    if len(raw) < 8 or raw[:2] not in (b"II", b"MM"):
        raise TiffError("no TIFF")
    o = "<" if raw[:2] == b"II" else ">"
    (magic,) = _at(o + "H", raw, 2)
    if magic == 42:
        at, count, entry, inline = _at(o + "I", raw, 4)[0], "H", "HHI", 4
    elif magic == 43:
        at, count, entry, inline = _at(o + "Q", raw, 8)[0], "Q", "HHQ", 8
    else:
        raise TiffError("no TIFF")
    tags: dict = {}
    try:
        (n,) = _at(o + count, raw, at)
        at += struct.calcsize(o + count)
        for _ in range(n):
            tag, kind, k = _at(o + entry, raw, at)
            at += struct.calcsize(o + entry)
            if kind in _TYPES:
                form = _TYPES[kind]
                size = struct.calcsize("=" + form) * k
                place = at if size <= inline else _at(o + ("I" if inline == 4 else "Q"), raw, at)[0]
                tags[tag] = raw[place : place + k].split(b"\0")[0].decode("latin-1") if kind == 2 else _at(f"{o}{k * len(form)}{form[0]}", raw, place)
            at += inline
    except struct.error as e:
        raise TiffError("a TIFF cut short") from e
    if WIDTH not in tags or HEIGHT not in tags:
        raise TiffError("a TIFF without size")
    bits, fmt = tags.get(BITS, (1,))[0], tags.get(SAMPLE_FORMAT, (1,))[0]
    kind = {1: "u", 2: "i", 3: "f"}.get(fmt)
    if kind is None or bits not in ((8, 16, 32) if kind != "f" else (32, 64)):
        raise TiffError(f"samples of {bits} bits and format {fmt}")
    return Header(tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0], f"{kind}{bits // 8}", tags, o)


def lzw_decode(raw: bytes) -> bytes:
    """Most significant bit first, the code width growing one code early."""
    out = bytearray()
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    width, bits, held, previous = 9, 0, 0, b""
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            bits -= width
            code = held >> bits
            held &= (1 << bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                del table[258:]
                width, previous = 9, b""
                continue
            entry = table[code] if code < len(table) else previous + previous[:1]
            out += entry
            if previous:
                table.append(previous + entry[:1])
            previous = entry
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
    return bytes(out)


def lzw_encode(raw: bytes) -> bytes:
    codes: list[tuple[int, int]] = [(256, 9)]
    table = {bytes([i]): i for i in range(256)}
    size, width, held = 258, 9, b""
    for i in range(len(raw)):
        grown = held + raw[i : i + 1]
        if grown in table:
            held = grown
            continue
        codes.append((table[held], width))
        table[grown] = size
        size += 1
        if size > (1 << width) - 1:
            width += 1
        if size >= 4094:
            codes.append((256, min(width, 12)))
            table = {bytes([j]): j for j in range(256)}
            size, width = 258, 9
        held = raw[i : i + 1]
    if held:
        codes.append((table[held], width))
        size += 1
        if size > (1 << width) - 1 and width < 12:
            width += 1
    codes.append((257, width))
    value = bits = 0
    out = bytearray()
    for code, w in codes:
        value, bits = value << w | code, bits + w
        while bits >= 8:
            bits -= 8
            out.append(value >> bits)
            value &= (1 << bits) - 1
    if bits:
        out.append(value << (8 - bits) & 0xFF)
    return bytes(out)


def blocks(h: Header) -> list[tuple[int, int, int, int]]:
    """(number, band or -1 for all, first row, first column) of every block."""
    bh, bw = h.block
    down, across = -(-h.height // bh), -(-h.width // bw)
    out = []
    for plane in range(h.bands if h.planar else 1):
        for r in range(down):
            for c in range(across):
                out.append((plane * down * across + r * across + c, plane if h.planar else -1, r * bh, c * bw))
    return out


def read_block(raw: bytes, h: Header, number: int) -> np.ndarray:
    """(rows, columns, samples) of one block, cut to the raster where it hangs over."""
    tiled = TILE_OFFSETS in h.tags
    at = h.tags[TILE_OFFSETS if tiled else STRIP_OFFSETS][number]
    size = h.tags[TILE_BYTES if tiled else STRIP_BYTES][number]
    data = raw[at : at + size]
    how = h.tags.get(COMPRESSION, (NONE,))[0]
    if how in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompress(data)
    elif how == LZW:
        data = lzw_decode(data)
    elif how != NONE:
        raise TiffError(f"compression {how}")
    bh, bw = h.block
    samples = 1 if h.planar else h.bands
    _, _, r, c = next(b for b in [blocks(h)[number]])
    rows = bh if tiled else min(bh, h.height - r)
    a = np.frombuffer(data, np.dtype(h.dtype).newbyteorder(h.order), rows * bw * samples).reshape(rows, bw, samples).astype(h.dtype)
    if h.tags.get(PREDICTOR, (1,))[0] == 2:
        a = np.cumsum(a, axis=1, dtype=a.dtype)
    return a[: h.height - r, : h.width - c]


def read_window(raw: bytes, h: Header, band: int, row: int = 0, col: int = 0, rows: int | None = None, cols: int | None = None) -> np.ndarray:
    """Part of a band (1-based) inside the raster; only the blocks it touches are decoded."""
    if not 1 <= band <= h.bands:
        raise IndexError(f"band {band} of {h.bands}")
    r1, c1 = min(h.height, row + (h.height if rows is None else rows)), min(h.width, col + (h.width if cols is None else cols))
    row, col = max(row, 0), max(col, 0)
    out = np.zeros((max(r1 - row, 0), max(c1 - col, 0)), h.dtype)
    bh, bw = h.block
    for number, plane, r, c in blocks(h):
        if plane not in (-1, band - 1) or r >= r1 or r + bh <= row or c >= c1 or c + bw <= col:
            continue
        a = read_block(raw, h, number)[:, :, 0 if plane >= 0 else band - 1]
        y0, y1, x0, x1 = max(r, row), min(r + a.shape[0], r1), max(c, col), min(c + a.shape[1], c1)
        out[y0 - row : y1 - row, x0 - col : x1 - col] = a[y0 - r : y1 - r, x0 - c : x1 - c]
    return out


def write(a: np.ndarray, bounds: tuple[float, float, float, float] | None = None, epsg: int | None = None, nodata: float | None = None, names: list[str] | None = None, compression: int = LZW, tile: int | None = 256, when: str | None = None) -> bytes:
    """A classic little-endian GeoTIFF of (bands, rows, columns) or (rows, columns), chunky."""
    a = a[None] if a.ndim == 2 else a
    n, h, w = a.shape
    data = np.ascontiguousarray(np.moveaxis(a, 0, -1)).astype(a.dtype.newbyteorder("<"))
    bh, bw = (tile, tile) if tile else (h, w)
    parts = []
    for r in range(0, h, bh):
        for c in range(0, w, bw):
            block = data[r : r + bh, c : c + bw]
            if tile:
                full = np.zeros((bh, bw, n), data.dtype)
                full[: block.shape[0], : block.shape[1]] = block
                block = full
            raw = block.tobytes()
            parts.append(zlib.compress(raw) if compression == DEFLATE else lzw_encode(raw) if compression == LZW else raw)
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    tags: dict[int, tuple[int, list | bytes]] = {
        WIDTH: (4, [w]), HEIGHT: (4, [h]), BITS: (3, [a.dtype.itemsize * 8] * n), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [1]),
        SAMPLES: (3, [n]), PLANAR: (3, [1]), SAMPLE_FORMAT: (3, [kind] * n),
    }
    tags |= {TILE_WIDTH: (3, [bw]), TILE_HEIGHT: (3, [bh])} if tile else {ROWS_PER_STRIP: (4, [h])}
    if when:
        tags[DATETIME] = (2, when.encode() + b"\0")
    if bounds:
        tags[PIXEL_SCALE] = (12, [(bounds[2] - bounds[0]) / w, (bounds[3] - bounds[1]) / h, 0.0])
        tags[TIEPOINT] = (12, [0.0, 0.0, 0.0, bounds[0], bounds[3], 0.0])
    if epsg:
        projected = epsg not in (4326, 4269, 4258)
        tags[GEO_KEYS] = (3, [1, 1, 0, 2, 1024, 0, 1, 1 if projected else 2, 3072 if projected else 2048, 0, 1, epsg])
    if names:
        items = "".join(f'<Item name="DESCRIPTION" sample="{i}" role="description">{x}</Item>' for i, x in enumerate(names))
        tags[GDAL_METADATA] = (2, f"<GDALMetadata>{items}</GDALMetadata>".encode() + b"\0")
    if nodata is not None:
        tags[GDAL_NODATA] = (2, f"{nodata:g}".encode() + b"\0")
    tags[TILE_OFFSETS if tile else STRIP_OFFSETS] = (4, [0] * len(parts))
    tags[TILE_BYTES if tile else STRIP_BYTES] = (4, [len(p) for p in parts])
    fixed = 8 + 2 + 12 * len(tags) + 4
    packed = {t: v if isinstance(v, bytes) else struct.pack(f"<{len(v)}{_TYPES[k]}", *v) for t, (k, v) in tags.items()}
    extra = sum(len(p) + len(p) % 2 for p in packed.values() if len(p) > 4)
    starts = list(np.cumsum([0, *[len(p) for p in parts[:-1]]]) + fixed + extra)
    packed[TILE_OFFSETS if tile else STRIP_OFFSETS] = struct.pack(f"<{len(starts)}I", *map(int, starts))
    head, tail = struct.pack("<2sHIH", b"II", 42, 8, len(tags)), b""
    for t in sorted(tags):
        k, v = tags[t]
        p = packed[t]
        count = len(v)
        if len(p) <= 4:
            head += struct.pack("<HHI", t, k, count) + p.ljust(4, b"\0")
        else:
            head += struct.pack("<HHII", t, k, count, fixed + len(tail))
            tail += p + b"\0" * (len(p) % 2)
    return head + struct.pack("<I", 0) + tail + b"".join(parts)
