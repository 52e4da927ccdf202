"""Hashes that Spark lacks: a 64-bit Jenkins hash, FNV-1a, and tokens and passwords of the access layer."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: Fixed values of Bob Jenkins's published lookup3 hash: its start, and the rotations of stirring and of the end.
START, STIR, END = 0xDEADBEEF, (4, 6, 8, 16, 19, 4), (14, 11, 25, 16, 4, 14, 24)
#: Fixed values of FNV-1a with 64 bits.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def _rotated(x: int, k: int) -> int:
    return ((x << k) | (x >> (32 - k))) & 0xFFFFFFFF


def jenkins64(data: bytes, seed: int = 0) -> int:
    """Both 32-bit words of lookup3 (hashlittle2), the primary one high; the seed's halves start them.

    The state is a wheel of three words. Each block of twelve bytes is added as three little-endian words and stirred;
    the last block, padded with zeros, goes through the closing rotations instead.
    """
    low = 0xFFFFFFFF
    state = [(START + len(data) + (seed >> 32)) & low] * 3
    state[2] = (state[2] + seed) & low
    if not data:
        return (state[2] << 32) | state[1]
    blocks = [data[i : i + 12].ljust(12, b"\0") for i in range(0, len(data), 12)]
    for block in blocks:
        state = [(x + int.from_bytes(block[4 * k : 4 * k + 4], "little")) & low for k, x in enumerate(state)]
        if block is not blocks[-1]:
            for step, turn in enumerate(STIR):  # a takes from c, b from a, c from b, twice around
                i, j, other = step % 3, (step + 2) % 3, (step + 1) % 3
                state[i] = ((state[i] - state[j]) & low) ^ _rotated(state[j], turn)
                state[j] = (state[j] + state[other]) & low
    for step, turn in enumerate(END):  # c takes from b, a from c, b from a, and so on
        i, j = (step + 2) % 3, (step + 1) % 3
        state[i] = ((state[i] ^ state[j]) - _rotated(state[j], turn)) & low
    return (state[2] << 32) | state[1]


def fnv1a64(data: bytes) -> int:
    h = FNV_START
    for byte in data:
        h = ((h ^ byte) * FNV_PRIME) & MASK
    return h


def jenkins64_many(values: list[bytes]) -> np.ndarray:
    """jenkins64 of each value as unsigned 64-bit numbers; values of as many blocks are worked on side by side."""
    out, length = np.zeros(len(values), np.uint64), np.array([len(v) for v in values], np.int64)
    blocks = (length + 11) // 12
    turned = lambda x, k: (x << np.uint32(k)) | (x >> np.uint32(32 - k))
    for n in np.unique(blocks).tolist():
        at = np.flatnonzero(blocks == n)
        state = [(length[at] + START).astype(np.uint32) for _ in range(3)]
        words = np.frombuffer(b"".join([values[i].ljust(12 * n, b"\0") for i in at.tolist()]), "<u4").reshape(len(at), n, 3)
        for block in range(n):
            state = [x + words[:, block, k] for k, x in enumerate(state)]
            for step, turn in enumerate(STIR if block < n - 1 else ()):
                i, j, other = step % 3, (step + 2) % 3, (step + 1) % 3
                state[i] = (state[i] - state[j]) ^ turned(state[j], turn)
                state[j] = state[j] + state[other]
        for step, turn in enumerate(END if n else ()):
            i, j = (step + 2) % 3, (step + 1) % 3
            state[i] = (state[i] ^ state[j]) - turned(state[j], turn)
        out[at] = (state[2].astype(np.uint64) << np.uint64(32)) | state[1]
    return out


def jenkins64_column(value: Column) -> Column:
    """jenkins64 of a string's UTF-8 bytes as a signed long, over Arrow batches; a batch's different values once."""

    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        code, own = pd.factorize(values)  # nulls: -1
        known = np.append(jenkins64_many([x.encode() for x in own]).view(np.int64), 0)
        return pd.Series(known[code]).astype("Int64").mask(code < 0)

    return run(value)


def cache_key(version: int, query: str) -> str:
    """The key of a query's cached result; another index version has other keys."""
    return f"search:v{version}:{fnv1a64(query.encode()):016x}"


def verify_password(password: str, salt_hex: str, hash_hex: str, rounds: int = 100_000) -> bool:
    made = hashlib.pbkdf2_hmac("sha256", password.encode(), bytes.fromhex(salt_hex), rounds)
    return hmac.compare_digest(made.hex(), hash_hex.lower())


def _b64(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def sign_token(claims: dict, secret: str) -> str:
    """A JSON web token with HMAC-SHA256."""
    body = ".".join(_b64(json.dumps(x, separators=(",", ":")).encode()) for x in ({"alg": "HS256", "typ": "JWT"}, claims))
    return f"{body}.{_b64(hmac.digest(secret.encode(), body.encode(), 'sha256'))}"


def verify_token(token: str, secret: str, now: int) -> tuple[bool, str]:
    """(accepted, reason): structure first, then signature, then expiry."""
    parts = token.split(".")
    if len(parts) != 3:
        return False, "malformed"
    if not hmac.compare_digest(_b64(hmac.digest(secret.encode(), f"{parts[0]}.{parts[1]}".encode(), "sha256")), parts[2]):
        return False, "bad signature"
    try:
        claims = json.loads(base64.urlsafe_b64decode(parts[1] + "=" * (-len(parts[1]) % 4)))
    except ValueError:
        return False, "malformed"
    return (True, "") if claims.get("exp", 0) > now else (False, "expired")


def claims_column(token: Column, schema: str) -> Column:
    """Claims of tokens, unverified, with expressions alone."""
    body = F.translate(F.split_part(token, F.lit("."), F.lit(2)), "-_", "+/")
    padded = F.rpad(body, F.length(body) + (4 - F.length(body) % 4) % 4, F.lit("="))
    return F.from_json(F.unbase64(padded).cast("string"), schema)
