"""Compact binary forms of number, cell and point lists, for binary columns.

Numbers: a varint count, then varints. Cells (sorted or not): varints of zigzag differences of the ids without the
zeros that all share at the end. Points: raw doubles, or E-degrees of a number of digits as differences.
"""

from __future__ import annotations

import struct

from sphera.operators.shapes import Point, from_degrees, to_degrees


def _put(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def _get(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _zigzag(n: int) -> int:
    return 2 * n if n >= 0 else -2 * n - 1


def _back(n: int) -> int:
    return n >> 1 if not n & 1 else -(n + 1 >> 1)


def encode_numbers(numbers: list[int]) -> bytes:
    out = bytearray()
    _put(out, len(numbers))
    for n in numbers:
        _put(out, n)
    return bytes(out)


def decode_numbers(data: bytes) -> list[int]:
    count, at = _get(data, 0)
    out = []
    for _ in range(count):
        n, at = _get(data, at)
        out.append(n)
    return out


def encode_cells(cells: list[int]) -> bytes:
    """Unsigned ids."""
    shared = min(((c & -c).bit_length() - 1 for c in cells if c), default=0)
    before, numbers = 0, [shared]
    for c in cells:
        numbers.append(_zigzag((c >> shared) - before))
        before = c >> shared
    return encode_numbers(numbers)


def decode_cells(data: bytes) -> list[int]:
    shared, *steps = decode_numbers(data)
    value, out = 0, []
    for s in steps:
        value += _back(s)
        out.append(value << shared)
    return out


def encode_points(points: list[Point], digits: int | None = None) -> bytes:
    """digits: degrees with so many decimals instead of exact coordinates."""
    if digits is None:
        return b"\0" + struct.pack(f"<{3 * len(points)}d", *[x for p in points for x in p])
    numbers, before = [digits], (0, 0)
    for p in points:
        at = tuple(round(d * 10**digits) for d in to_degrees(p))
        numbers += [_zigzag(a - b) for a, b in zip(at, before, strict=True)]
        before = at
    return b"\1" + encode_numbers(numbers)


def decode_points(data: bytes) -> list[Point]:
    if data[0] == 0:
        flat = struct.unpack(f"<{(len(data) - 1) // 8}d", data[1:])
        return [tuple(flat[i : i + 3]) for i in range(0, len(flat), 3)]
    digits, *steps = decode_numbers(data[1:])
    lat = lng = 0
    out = []
    for i in range(0, len(steps), 2):
        lat, lng = lat + _back(steps[i]), lng + _back(steps[i + 1])
        out.append(from_degrees(lat / 10**digits, lng / 10**digits))
    return out
