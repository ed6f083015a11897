"""Hashes and identifiers as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the 64-bit FNV-1a hash: the offset basis in two halves, and the prime 2^40 + 435.
BASIS_HIGH, BASIS_LOW, PRIME_LOW, PRIME_SHIFT = 0xCBF29CE4, 0x84222325, 435, 8
_HALF = 0xFFFFFFFF


def byte_values(data: Column) -> Column:
    """The bytes of a binary column as an array of ints."""
    pairs = F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0))
    return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int"))


def bracketed(data: Column) -> Column:
    """The text that is hashed for a payload: its bytes in decimal, in brackets, parted by spaces."""
    return F.concat(F.lit("["), F.array_join(F.transform(byte_values(data), lambda b: b.cast("string")), " "), F.lit("]"))


def _fold(values: Column) -> Column:
    """FNV-1a over byte values as two 32-bit halves; plain 64-bit products would overflow under ANSI rules."""
    start = F.struct(F.lit(BASIS_HIGH).cast("long").alias("hi"), F.lit(BASIS_LOW).cast("long").alias("lo"))

    def step(a: Column, b: Column) -> Column:
        x = a["lo"].bitwiseXOR(b.cast("long"))
        low = x * PRIME_LOW
        high = a["hi"] * PRIME_LOW + F.shiftright(low, 32) + F.shiftleft(x, PRIME_SHIFT)
        return F.struct(high.bitwiseAND(F.lit(_HALF)).alias("hi"), low.bitwiseAND(F.lit(_HALF)).alias("lo"))

    return F.aggregate(values, start, step)


def fnv1a_expression(payload: Column) -> Column:
    """FNV-1a 64 of a payload's bracketed text as a long with its bits, by built-in functions alone."""
    text = bracketed(payload.cast("binary"))
    h = _fold(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii))
    return F.shiftleft(h["hi"], 32).bitwiseOR(h["lo"])


#: So many payloads are worth a step of arrays.
FEW = 24


def _advanced(h: int, data: bytes, first: bool) -> int:
    """The hash after the decimal numbers of these bytes; a space goes before each but the very first."""
    prime, mask, digits = 2**40 + PRIME_LOW, 2**64 - 1, [str(b).encode() for b in range(256)]
    for b in data:
        if not first:
            h = (h ^ 32) * prime & mask
        first = False
        for d in digits[b]:
            h = (h ^ d) * prime & mask
    return h


def fnv1a_of(data: list[bytes]) -> np.ndarray:
    """FNV-1a 64 of each payload's bracketed text: all payloads advance by a byte at a time, the longest first. Where fewer
    than FEW are that long, each is hashed to its end by itself, so a long payload doesn't hold up its batch."""
    prime = np.uint64(2**40 + PRIME_LOW)
    lens = np.array([len(b) for b in data], dtype=np.int64)
    order = np.argsort(-lens, kind="stable")
    buf, begin = np.frombuffer(b"".join(data) + b"\0", dtype=np.uint8), (np.cumsum(lens) - lens)[order]
    lens = lens[order]
    h = np.full(len(data), BASIS_HIGH << 32 | BASIS_LOW, dtype=np.uint64)
    h = (h ^ np.uint64(ord("["))) * prime
    live = np.searchsorted(-lens, -np.arange(1, int(lens.max(initial=0)) + 1), side="right")
    for at, n in enumerate(live.tolist()):
        if n < FEW:
            for i in range(n):
                h[i] = _advanced(int(h[i]), buf[begin[i] + at : begin[i] + lens[i]].tobytes(), at == 0)
            break
        b, x = buf[begin[:n] + at].astype(np.uint64), h[:n]
        if at:
            x = (x ^ np.uint64(ord(" "))) * prime
        for ten in (100, 10):
            step = (x ^ (b // np.uint64(ten) % np.uint64(10) + np.uint64(48))) * prime
            x = np.where(b >= ten, step, x)
        h[:n] = (x ^ (b % np.uint64(10) + np.uint64(48))) * prime
    out = np.empty_like(h)
    out[order] = (h ^ np.uint64(ord("]"))) * prime
    return out


@F.pandas_udf(T.LongType())
def _fnv1a(data: pd.Series) -> pd.Series:
    held = data.isna()
    out = pd.Series(fnv1a_of([b"" if none else bytes(b) for b, none in zip(data, held, strict=True)]).view(np.int64), dtype="Int64")
    out[held.to_numpy()] = pd.NA
    return out


def fnv1a(payload: Column) -> Column:
    """The same in batches of payloads, which is many times as fast as a fold over characters in the JVM."""
    return _fnv1a(payload.cast("binary"))


def fnv1a_hex(payload: Column) -> Column:
    """The hash as 16 hex digits."""
    return F.lower(F.lpad(F.hex(fnv1a(payload)), 16, "0"))


def bucket(h: Column, n: int) -> Column:
    """A long's unsigned value modulo n; 0 for null, as a failed hash has."""
    return F.coalesce((F.shiftrightunsigned(h, 1) % n * 2 + h.bitwiseAND(F.lit(1).cast("long"))) % n, F.lit(0)).cast("int")


def fnv1a_bucket(payload: Column, n: int) -> Column:
    """The unsigned hash modulo n; a null payload goes to 0."""
    return bucket(fnv1a(payload), n)


def rendezvous(payload: Column, n: int) -> Column:
    """0 to n - 1, such that one more bucket takes its share of the values and moves no others."""
    scores = F.array(*[F.xxhash64(payload, F.lit(i)) for i in range(n)])
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def uint64_to_bytes(n: Column) -> Column:
    """An unsigned 64-bit number, as decimal(20, 0) or long, in 8 bytes, big-endian."""
    return F.unhex(F.lpad(F.conv(n.cast("decimal(20,0)").cast("string"), 10, 16), 16, "0"))


def bytes_to_uint64(data: Column) -> Column:
    """8 bytes, big-endian, as decimal(20, 0)."""
    return F.conv(F.hex(data), 16, 10).cast("decimal(20,0)")


def uuid7(at: Column | None = None) -> Column:
    """A time-ordered UUID, version 7: milliseconds since the epoch, then random bits. Not deterministic."""
    ms = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp() if at is None else at))), 12, "0")
    rnd = F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(rnd, 31, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7"), F.substring(rnd, 1, 3), F.lit("-"), variant, F.substring(rnd, 4, 3), F.lit("-"), F.substring(rnd, 18, 12))
