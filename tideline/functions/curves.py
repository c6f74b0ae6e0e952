"""Keys of space-filling curves. Z-order and Gray keys are bit strings made by built-in functions; string order is curve order.
Hilbert keys are bit strings from an Arrow UDF over numpy. Decoders give the coordinates back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.config import GRAY, HILBERT, ZORDER


def _bound(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def _zorder_bits(q: Column, bits: int) -> Column:
    inside = F.forall(q, lambda x: (x >= 0) & (x < F.lit(1 << bits)))
    sound = F.when(F.coalesce(inside, F.lit(True)), q).otherwise(F.raise_error(F.lit(f"curve key: a coordinate is not in 0..2**{bits}-1")).cast("array<bigint>"))
    binary = F.transform(sound, lambda x: F.lpad(F.bin(x), bits, "0"))
    return _bound(binary, lambda own: F.flatten(F.transform(F.sequence(F.lit(1), F.lit(bits)), lambda i: F.transform(own, lambda b: F.substr(b, i, F.lit(1))))))


def zorder_key(q: Column, bits: int) -> Column:
    """Interleaved bits, the most significant of every coordinate first. q: array of integers in 0..2**bits-1."""
    return F.array_join(_zorder_bits(q, bits), "")


def gray_key(q: Column, bits: int) -> Column:
    """The Gray code of the z-order key: each bit is its exclusive or with the one before."""

    def coded(z: Column) -> Column:
        before = F.slice(F.concat(F.array(F.lit("0")), z), F.lit(1), F.size(z))
        return F.array_join(F.zip_with(z, before, lambda a, b: F.when(a == b, "0").otherwise("1")), "")

    return _bound(_zorder_bits(q, bits), coded)


def _transposed(x: np.ndarray, bits: int) -> np.ndarray:
    """Coordinates (n by d) to the transposed Hilbert index, by Skilling's method."""
    if len(x) and (x.min() < 0 or int(x.max()) >= 1 << bits):
        raise ValueError(f"curve key: a coordinate is not in 0..2**{bits}-1")
    x = x.astype(np.int64).copy()
    d = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[:, i] & q) > 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(high, x[:, 0] ^ p, x[:, 0] ^ swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    t, q = np.zeros(len(x), np.int64), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[:, d - 1] & q, t ^ (q - 1), t)
        q >>= 1
    return x ^ t[:, None]


def _untransposed(x: np.ndarray, bits: int) -> np.ndarray:
    x = x.astype(np.int64).copy()
    d = x.shape[1]
    t = x[:, d - 1] >> 1
    for i in range(d - 1, 0, -1):
        x[:, i] ^= x[:, i - 1]
    x[:, 0] ^= t
    q = 2
    while q != 1 << bits:
        p = q - 1
        for i in range(d - 1, -1, -1):
            high = (x[:, i] & q) > 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(high, x[:, 0] ^ p, x[:, 0] ^ swap)
            x[:, i] ^= swap
        q <<= 1
    return x


def _bit_strings(x: np.ndarray, bits: int) -> list[str]:
    planes = (x[:, None, :] >> np.arange(bits - 1, -1, -1)[None, :, None]) & 1
    return [b.tobytes().decode() for b in (planes.reshape(len(x), -1) + 48).astype(np.uint8)]


def _coordinates(key: str, d: int, bits: int) -> np.ndarray:
    planes = np.frombuffer(key.encode(), np.uint8).reshape(bits, d).astype(np.int64) - 48
    return (planes << np.arange(bits - 1, -1, -1)[:, None]).sum(0)


def hilbert_keys(x: np.ndarray, bits: int) -> list[str]:
    return _bit_strings(_transposed(x, bits), bits) if len(x) else []


def hilbert_key(q: Column, bits: int) -> Column:
    @F.pandas_udf("string")
    def keys(s: pd.Series) -> pd.Series:
        return pd.Series(hilbert_keys(np.stack(s.to_list()) if len(s) else np.zeros((0, 1), np.int64), bits))

    return keys(q)


def decode(key: str, curve: str, d: int, bits: int) -> list[int]:
    """The coordinates of a key."""
    if curve == GRAY:
        planes = np.frombuffer(key.encode(), np.uint8) - 48
        key = (np.bitwise_xor.accumulate(planes) + 48).tobytes().decode()
    x = _coordinates(key, d, bits)
    return (_untransposed(x[None, :], bits)[0] if curve == HILBERT else x).tolist()


def curve_key(q: Column, curve: str, bits: int) -> Column:
    return {ZORDER: zorder_key, GRAY: gray_key, HILBERT: hilbert_key}[curve](q, bits)
