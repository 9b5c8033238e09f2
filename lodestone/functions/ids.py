"""Hashes, blinding, encryption and framing of log entries."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = b"\x01\x00"


def entry_id(client: Column, seq: Column) -> Column:
    return F.sha2(F.concat_ws(":", client, seq.cast("string")), 256)


def record_hash(record: Column, project: Column) -> Column:
    return F.sha2(F.concat(record, F.lit(":"), F.coalesce(project, F.lit(""))), 256)


def project_id(path: str) -> str:
    return hashlib.sha256(path.encode()).hexdigest()[:16]


def token_hash(token: str) -> str:
    return hashlib.sha256(token.encode()).hexdigest()


def hkdf(key: bytes, info: bytes, length: int = 32) -> bytes:
    """HKDF-SHA256 (RFC 5869) without salt."""
    prk = hmac.new(bytes(32), key, hashlib.sha256).digest()
    out, block, i = b"", b"", 1
    while len(out) < length:
        block = hmac.new(prk, block + info + bytes([i]), hashlib.sha256).digest()
        out, i = out + block, i + 1
    return out[:length]


def blind_project(key: bytes, project: str, info: bytes = b"project-blinding") -> str:
    """64 hex digits that stand for a project where its name must not be seen.  One value a project: made on the driver."""
    return hmac.new(hkdf(key, info), project.encode(), hashlib.sha256).hexdigest()


def encrypt(plain: Column, key: Column, aad: Column) -> Column:
    """Version, then AES-256-GCM nonce, ciphertext and tag."""
    return F.concat(F.lit(VERSION), F.aes_encrypt(plain, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), aad))


def decrypt(blob: Column, key: Column, aad: Column) -> Column:
    """The plain bytes; null for another version, key or additional data."""
    return F.when(F.substring(blob, 1, 2) == F.lit(VERSION), F.try_aes_decrypt(F.substring(blob, 3, 1 << 30), key, F.lit("GCM"), F.lit("DEFAULT"), aad))


def framed(blob: Column) -> Column:
    """Length (4 bytes, big-endian), then the bytes."""
    return F.concat(F.unhex(F.lpad(F.hex(F.length(blob)), 8, "0")), blob)


def unframe(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            raise ValueError("truncated frame")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out
