"""Baseline JPEG frames: a decoder for 8-bit grey and YCbCr images of any sampling, and a small encoder for fixtures.

Motion-JPEG frames usually leave out their Huffman tables; the standard ones are then used.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

_RESTART = re.compile(rb"\xff[\xd0-\xd7]")

ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
_K = np.arange(8)
#: Orthonormal cosine basis: samples = BASIS.T @ coefficients @ BASIS.
BASIS = np.sqrt(np.where(_K == 0, 1, 2) / 8)[:, None] * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)
#: The inverse transform of a whole block at once, from zigzag coefficients.
INVERSE = np.stack([np.outer(BASIS[z // 8], BASIS[z % 8]).ravel() for z in ZIGZAG]).astype(np.float32)

_DC_LUMA = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12)))
_DC_CHROMA = (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12)))
_AC_LUMA = (
    bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 0x7D]),
    bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"),
)
_AC_CHROMA = (
    bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 0x77]),
    bytes.fromhex("0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa".replace(" ", "")),
)
STANDARD = {0x00: _DC_LUMA, 0x10: _AC_LUMA, 0x01: _DC_CHROMA, 0x11: _AC_CHROMA}


class BadFrame(ValueError):
    """The bytes are no baseline JPEG that can be decoded."""


@lru_cache(maxsize=64)
def _lookup(counts: bytes, symbols: bytes, dc: bool) -> list[tuple[int, int, int] | None]:
    """For each 16 bits: (length, run, size) of the code that they begin with; a negative run says how many bits of the
    value already lie in the 16 bits, whose length then covers code and value: (length, -1 - run, value). None for no code."""
    table: list[tuple[int, int, int] | None] = [None] * 65536
    code, k = 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            if k >= len(symbols) or code >= 1 << length:
                raise BadFrame("broken Huffman table")
            run, size = (0, symbols[k]) if dc else (symbols[k] >> 4, symbols[k] & 15)
            low, wide = code << (16 - length), 1 << (16 - length)
            if 0 < size <= 16 - length:  # the value follows inside the 16 bits
                step = wide >> size
                for v in range(1 << size):
                    value = v if v >> (size - 1) else v - (1 << size) + 1
                    table[low + v * step : low + (v + 1) * step] = [(length + size, -1 - run, value)] * step
            else:
                table[low : low + wide] = [(length, run, size)] * wide
            code += 1
            k += 1
        code <<= 1
    return table


def _parts(data: bytes, restart: int) -> list[bytes]:
    """The entropy-coded runs between restart markers, without stuffing."""
    if not restart:
        return [data.replace(b"\xff\x00", b"\xff")]
    return [p.replace(b"\xff\x00", b"\xff") for p in _RESTART.split(data)]


def _scan(data: bytes, plan: list[tuple[int, list, list]], units: int, restart: int, components: int) -> list[list[tuple[int, int, int]]]:
    """For each component the (block, zigzag place, value) of its coefficients. plan: component and tables of each block of a unit."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(components)]
    done = [0] * components
    unit = 0
    for part in _parts(data, restart):
        n = 8 * len(part)
        # windows of 32 bits from each byte on; beyond the end zeros, for a while
        padded = np.frombuffer(part + bytes(64), np.uint8).astype(np.int64)
        words = (padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]).tolist()
        at = 0
        last = [0] * components
        for _ in range(min(restart or units, units - unit)):
            for c, dc, ac in plan:
                block, coefficients = done[c], out[c]
                done[c] += 1
                k, table = 0, dc
                while k < 64:
                    if at > n + 256:
                        raise BadFrame("the scan ends too early")
                    found = table[words[at >> 3] >> (16 - (at & 7)) & 0xFFFF]
                    if found is None:
                        raise BadFrame("no such code")
                    length, run, value = found
                    at += length
                    if run < 0:
                        k -= run + 1
                    else:
                        size = value
                        if size:
                            k += run
                            value = words[at >> 3] >> (32 - (at & 7) - size) & ((1 << size) - 1) if size <= 24 else 0
                            at += size
                            if not value >> (size - 1):
                                value -= (1 << size) - 1
                        elif k:
                            if run != 15:
                                break
                            k += 16
                            continue
                    if not k:
                        last[c] += value
                        value = last[c]
                        table = ac
                    if k > 63:
                        raise BadFrame("too many coefficients")
                    if value:
                        coefficients.append((block, k, value))
                    k += 1
            unit += 1
    if unit < units:
        raise BadFrame("blocks are missing")
    return out


@dataclass
class Header:
    """What the segments before the first entropy-coded byte say."""

    end: int
    width: int
    height: int
    restart: int
    parts: list[tuple[int, int, int]]  # horizontal and vertical sampling and quantiser of each component
    quant: dict[int, np.ndarray]
    plan: list[tuple[int, list, list]]

    @property
    def units(self) -> tuple[int, int]:
        return -(-self.width // (8 * max(h for h, _, _ in self.parts))), -(-self.height // (8 * max(v for _, v, _ in self.parts)))


def decode(data: bytes) -> list[np.ndarray]:
    """The planes of a frame (Y, or Y, Cb, Cr) as uint8 arrays, chroma at its own resolution. BadFrame if that can't be done."""
    (planes,) = decode_all([data])
    if isinstance(planes, BadFrame):
        raise planes
    return planes


def decode_all(frames: list[bytes]) -> list[list[np.ndarray] | BadFrame]:
    """The planes of each frame, or why it can't be decoded. Frames that begin alike share their header, and all blocks of
    one header and component go through the inverse transform at once."""
    out: list[list[np.ndarray] | BadFrame] = [BadFrame("not decoded")] * len(frames)
    known: list[tuple[bytes, Header]] = []
    groups: dict[int, list[tuple[int, list]]] = {}
    for i, data in enumerate(frames):
        try:
            number = next((k for k, (head, _) in enumerate(known) if data.startswith(head)), -1)
            if number < 0:
                header = _header(data)
                number = len(known)
                known.append((bytes(data[: header.end]), header))
            header = known[number][1]
            end = data.rfind(b"\xff\xd9")
            ux, uy = header.units
            found = _scan(data[header.end : end if end >= header.end else len(data)], header.plan, ux * uy, header.restart, len(header.parts))
            groups.setdefault(number, []).append((i, found))
        except BadFrame as e:
            out[i] = e
        except (IndexError, KeyError, ZeroDivisionError, ValueError, TypeError) as e:
            out[i] = BadFrame(str(e))
    for number, members in groups.items():
        header = known[number][1]
        for at in range(0, len(members), 64):
            for i, planes in _planes(header, members[at : at + 64]):
                out[i] = planes
    return out


def _planes(header: Header, members: list[tuple[int, list]]) -> list[tuple[int, list[np.ndarray] | BadFrame]]:
    ux, uy = header.units
    across, down = max(h for h, _, _ in header.parts), max(v for _, v, _ in header.parts)
    result: list[list[np.ndarray]] = [[] for _ in members]
    for c, (h, v, q) in enumerate(header.parts):
        if q not in header.quant or len(header.quant[q]) != 64:
            return [(i, BadFrame("no quantiser")) for i, _ in members]
        per = ux * uy * h * v
        blocks = np.zeros((per * len(members), 64), np.float32)
        for m, (_, found) in enumerate(members):
            if found[c]:
                b, k, x = np.array(found[c]).T
                blocks[b + m * per, k] = x
        pixels = (blocks * header.quant[q]) @ INVERSE + 128
        pixels = np.clip(np.rint(pixels), 0, 255).astype(np.uint8).reshape(len(members), uy, ux, v, h, 8, 8)
        planes = pixels.transpose(0, 1, 3, 5, 2, 4, 6).reshape(len(members), uy * v * 8, ux * h * 8)
        for m in range(len(members)):
            result[m].append(planes[m, : -(-header.height * v // down), : -(-header.width * h // across)])
    return [(i, planes) for (i, _), planes in zip(members, result, strict=True)]


def _header(data: bytes) -> Header:
    if data[:2] != b"\xff\xd8":
        raise BadFrame("no start of image")
    quant: dict[int, np.ndarray] = {}
    huffman = dict(STANDARD)
    frame: list[tuple[int, int, int, int]] = []
    width = height = restart = 0
    at = 2
    while True:
        while data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        if data[at] != 0xFF:
            raise BadFrame("no marker")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                n = 128 if wide else 64
                quant[body[k] & 15] = np.frombuffer(body[k + 1 : k + 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
                k += 1 + n
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                huffman[body[k]] = (bytes(body[k + 1 : k + 17]), bytes(body[k + 17 : k + 17 + n]))
                k += 17 + n
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise BadFrame("not 8 bits")
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif marker in (0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
            raise BadFrame("not baseline")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            break
        elif marker == 0xD9:
            raise BadFrame("no scan")
    if not frame or not width or not height or body[0] != len(frame):
        raise BadFrame("no frame, no size, or a scan of its own for each component")
    tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    if len(frame) == 1:
        frame = [(frame[0][0], 1, 1, frame[0][3])]
    plan = []
    for c, (ident, h, v, _) in enumerate(frame):
        plan += [(c, _lookup(*huffman[tables[ident] >> 4], True), _lookup(*huffman[0x10 | tables[ident] & 15], False))] * (h * v)
    return Header(at, width, height, restart, [(h, v, q) for _, h, v, q in frame], quant, plan)


@lru_cache(maxsize=8)
def _codes(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    codes, code, k = {}, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            codes[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return codes


def _bits(blocks: list[tuple[int, list[int], bool]], restart_last: dict[int, int], tables: list[tuple[dict, dict]]) -> bytes:
    """The entropy-coded bytes of (component, zigzag coefficients, whether any but the first isn't 0) blocks, padded with ones."""
    bits, n = 0, 0
    for c, block, busy in blocks:
        dc, ac = tables[1 if c else 0]
        difference, restart_last[c] = block[0] - restart_last.get(c, 0), block[0]
        size = abs(difference).bit_length()
        code, length = dc[size]
        bits, n = (bits << length | code) << size | (difference if difference >= 0 else difference + (1 << size) - 1), n + length + size
        at = 1
        for k in [k for k in range(1, 64) if block[k]] if busy else ():
            while k - at > 15:
                bits, n = bits << ac[0xF0][1] | ac[0xF0][0], n + ac[0xF0][1]
                at += 16
            value = block[k]
            size = abs(value).bit_length()
            code, length = ac[(k - at) << 4 | size]
            bits, n = (bits << length | code) << size | (value if value >= 0 else value + (1 << size) - 1), n + length + size
            at = k + 1
        if at < 64:
            bits, n = bits << ac[0][1] | ac[0][0], n + ac[0][1]
    bits, n = bits << (-n % 8) | ((1 << (-n % 8)) - 1), n + -n % 8
    return bits.to_bytes(n // 8, "big").replace(b"\xff", b"\xff\x00")


def encode(planes: list[np.ndarray], sampling: tuple[int, int] = (1, 1), step: int = 8, tables: bool = False, restart: int = 0) -> bytes:
    """A baseline frame of one plane or three, with one quantiser step; without Huffman tables unless asked for. ``sampling``: blocks
    of luma across and down for one of each chroma; ``restart``: units between restart markers, 0 for none."""
    across, down = sampling if len(planes) == 3 else (1, 1)
    height, width = planes[0].shape
    ux, uy = -(-width // (8 * across)), -(-height // (8 * down))
    units: list[list[tuple[int, list[int], bool]]] = [[] for _ in range(ux * uy)]
    for c, plane in enumerate(planes):
        h, v = (across, down) if c == 0 else (1, 1)
        tall, wide = uy * v * 8, ux * h * 8
        padded = plane.astype(np.float64) - 128
        if plane.shape != (tall, wide):
            padded = np.pad(padded, ((0, tall - plane.shape[0]), (0, wide - plane.shape[1])), "edge")
        blocks = padded.reshape(uy, v, 8, ux, h, 8).transpose(0, 3, 1, 4, 2, 5).reshape(-1, 8, 8)
        done = np.rint((BASIS @ blocks @ BASIS.T) / step).astype(int).reshape(-1, 64)[:, ZIGZAG]
        for k, (block, busy) in enumerate(zip(done.tolist(), done[:, 1:].any(axis=1).tolist(), strict=True)):
            units[k // (h * v)].append((c, block, busy))
    codes = [(_codes(*_DC_LUMA), _codes(*_AC_LUMA)), (_codes(*_DC_CHROMA), _codes(*_AC_CHROMA))]
    every = restart or len(units)
    runs = [_bits([b for unit in units[at : at + every] for b in unit], {}, codes) for at in range(0, len(units), every)]
    entropy = runs[0] + b"".join(bytes([0xFF, 0xD0 + k % 8]) + run for k, run in enumerate(runs[1:]))
    head = b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes([step] * 64)
    n = len(planes)
    head += b"\xff\xc0" + (8 + 3 * n).to_bytes(2, "big") + b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([n])
    head += b"".join(bytes([c + 1, (across << 4 | down) if c == 0 else 0x11, 0]) for c in range(n))
    if tables:
        for ident, (counts, symbols) in sorted(STANDARD.items()):
            if n == 3 or not ident & 1:
                head += b"\xff\xc4" + (3 + 16 + len(symbols)).to_bytes(2, "big") + bytes([ident]) + counts + symbols
    if restart:
        head += b"\xff\xdd\x00\x04" + restart.to_bytes(2, "big")
    return head + b"\xff\xda" + (6 + 2 * n).to_bytes(2, "big") + bytes([n]) + b"".join(bytes([c + 1, 0x11 if c else 0]) for c in range(n)) + b"\x00\x3f\x00" + entropy + b"\xff\xd9"


def encode_grey(pixels: np.ndarray, step: int = 8, tables: bool = False) -> bytes:
    return encode([pixels], step=step, tables=tables)
