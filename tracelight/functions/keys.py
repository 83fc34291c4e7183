"""Digests, identifiers and keyed derivation as Column expressions.

A keyed digest is composed from SHA-256, so it stays inside code generation.  The pads of a key become
literals of the plan and show in ``explain``: keep to keys that may be seen, or redact plans.
"""

from __future__ import annotations

import hashlib
import hmac
import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names the derivation; both sides of a comparison must agree on it.
PROTOCOL = "TL-1"
SLOTS = ("statement-abstract", "scope-abstract", "statement-exact", "scope-exact")
# The alphabet of lower-case base 32 without padding.
BASE32 = "abcdefghijklmnopqrstuvwxyz234567"


def sha256(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def hex_lower(value: Column) -> Column:
    return F.lower(F.hex(value))


def framed(domain: str, *fields: Column) -> Column:
    """An injective message: protocol, domain and number of fields, then each field with its length."""
    head = PROTOCOL.encode() + b"\0" + domain.encode() + b"\0" + len(fields).to_bytes(4, "big")
    parts: list[Column] = [F.lit(head)]
    for f in fields:
        b = f.cast("binary")
        parts += [F.unhex(F.lpad(F.hex(F.octet_length(b)), 8, "0")), b]
    return F.concat(*parts)


def framed_bytes(domain: str, *fields: bytes) -> bytes:
    """The same message on the driver."""
    out = PROTOCOL.encode() + b"\0" + domain.encode() + b"\0" + len(fields).to_bytes(4, "big")
    return out + b"".join(len(f).to_bytes(4, "big") + f for f in fields)


def _pads(key: bytes) -> tuple[bytes, bytes]:
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Keyed digest of a binary column."""
    inner, outer = _pads(key)
    return sha256(F.concat(F.lit(outer), sha256(F.concat(F.lit(inner), message))))


def derive(root: bytes, domain: str, *fields: bytes) -> bytes:
    """A key for one purpose, on the driver."""
    return hmac.new(root, framed_bytes(domain, *fields), hashlib.sha256).digest()


def location_id(key: bytes, slot: int, digest: Column) -> Column:
    """16 bytes that name a place by what stands around it."""
    return F.substring(hmac_sha256(key, framed("location", F.lit(bytes([slot])), digest)), 1, 16)


def low_bits(digest: Column, width: int) -> Column:
    """The low ``width`` bits of the first four bytes."""
    first = F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long")
    return first.bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def fragment_tag(key: bytes, location: Column, width: int) -> Column:
    return low_bits(hmac_sha256(key, framed("tag", location, F.lit(bytes([width])))), width)


def selection_priority(key: bytes, locations: Column) -> Column:
    return hmac_sha256(key, framed("selection", locations))


def index_of(digest: Column, n: int) -> Column:
    """The digest as one big-endian number, modulo ``n``."""
    nibbles = F.split(F.hex(digest), "")
    value = lambda c: F.conv(c, 16, 10).cast("long")
    step = lambda acc, c: F.when(c == "", acc).otherwise((acc * 16 + value(c)) % n)
    return F.aggregate(nibbles, F.lit(0).cast("long"), step)


def base32_lower(digest: Column, size: int) -> Column:
    """Unpadded lower-case base 32 of ``size`` bytes."""
    bits = F.array_join(F.transform(F.split(F.substring(F.hex(digest), 1, 2 * size), ""), lambda c: F.when(c == "", "").otherwise(F.lpad(F.conv(c, 16, 2), 4, "0"))), "")
    count = -(-size * 8 // 5)
    padded = F.rpad(bits, count * 5, "0")
    letter = lambda i: F.substring(F.lit(BASE32), (F.conv(F.substring(padded, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), letter), "")


def is_project_id(value: Column, prefix: str = "prj1-") -> Column:
    return F.regexp_like(F.lower(value), F.lit(f"^{prefix}[a-z2-7]{{16}}$"))


def is_release_id(value: Column) -> Column:
    return F.regexp_like(F.lower(value), F.lit("^rel-[a-z2-7]{1,32}$"))


def constant_time_equal(a: bytes, b: bytes) -> bool:
    return hmac.compare_digest(a, b)


def random_bytes(n: int = 32) -> bytes:
    return secrets.token_bytes(n)
