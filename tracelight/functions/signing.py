"""Ed25519 signatures (RFC 8032) on the driver, by the formulas of the standard.

Not hardened against timing: the signer signs its own documents on its own machine.
"""

from __future__ import annotations

import hashlib

P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, -1, P) % P
_ROOT = pow(2, (P - 1) // 4, P)
Point = tuple[int, int, int, int]  # extended coordinates x, y, z, t


def _add(a: Point, b: Point) -> Point:
    e, f = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    g, h = 2 * a[3] * b[3] * _D % P, 2 * a[2] * b[2] % P
    w, x, y, z = f - e, h - g, h + g, f + e
    return w * x % P, y * z % P, x * y % P, w * z % P


def _times(n: int, a: Point) -> Point:
    out: Point = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, a)
        a = _add(a, a)
        n >>= 1
    return out


def _x(y: int, odd: int) -> int | None:
    if y >= P:
        return None
    square = (y * y - 1) * pow(_D * y * y + 1, -1, P) % P
    if square == 0:
        return None if odd else 0
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * _ROOT % P
    if (x * x - square) % P:
        return None
    return P - x if x & 1 != odd else x


_Y = 4 * pow(5, -1, P) % P
_X = _x(_Y, 0)
_BASE: Point = (_X, _Y, 1, _X * _Y % P)


def _pack(a: Point) -> bytes:
    z = pow(a[2], -1, P)
    x, y = a[0] * z % P, a[1] * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(data: bytes) -> Point | None:
    if len(data) != 32:
        return None
    n = int.from_bytes(data, "little")
    y = n & ((1 << 255) - 1)
    x = _x(y, n >> 255)
    return None if x is None else (x, y, 1, x * y % P)


def _equal(a: Point, b: Point) -> bool:
    return (a[0] * b[2] - b[0] * a[2]) % P == 0 and (a[1] * b[2] - b[1] * a[2]) % P == 0


def _expanded(seed: bytes) -> tuple[int, bytes]:
    if len(seed) != 32:
        raise ValueError("a seed has 32 bytes")
    h = hashlib.sha512(seed).digest()
    return int.from_bytes(h[:32], "little") & ((1 << 254) - 8) | 1 << 254, h[32:]


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % ORDER


def public_key(seed: bytes) -> bytes:
    return _pack(_times(_expanded(seed)[0], _BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    scalar, prefix = _expanded(seed)
    key = _pack(_times(scalar, _BASE))
    r = _number(prefix, message)
    point = _pack(_times(r, _BASE))
    return point + ((r + _number(point, key, message) * scalar) % ORDER).to_bytes(32, "little")


def verify(key: bytes, message: bytes, signature: bytes) -> bool:
    a, r = _unpack(key), _unpack(signature[:32])
    s = int.from_bytes(signature[32:], "little")
    if a is None or r is None or len(signature) != 64 or s >= ORDER:
        return False
    return _equal(_times(s, _BASE), _add(r, _times(_number(signature[:32], key, message), a)))
