"""MS-Numpress coding after the published description of the format: linear for m/z, short logged floats and positive integers for intensities."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd


def fixed_point(values: np.ndarray) -> float:
    """The largest scale at which values and their extrapolations fit in 31 bits."""
    if len(values) == 0:
        return 0.0
    if len(values) == 1:
        return float(np.floor(0x7FFFFFFF / max(abs(float(values[0])), 1e-9)))
    ahead = 2 * values[1:-1] - values[:-2] if len(values) > 2 else np.zeros(0)
    largest = max(float(np.abs(values[:2]).max()), float(np.ceil(np.abs(values[2:] - ahead) + 1).max(initial=1.0)))
    return float(np.floor(0x7FFFFFFF / max(largest, 1e-9)))


def nibbles_of(x: int) -> list[int]:
    """A signed 32-bit number in half bytes: how many leading ones are left out, then the others from the lowest."""
    u = x & 0xFFFFFFFF
    digits = [(u >> (4 * k)) & 15 for k in range(8)]
    if digits[7] == 0:
        lead = next((k for k in range(8) if digits[7 - k] != 0), 8)
        return [lead, *digits[: 8 - lead]]
    if digits[7] == 15:
        lead = min(next((k for k in range(8) if digits[7 - k] != 15), 8), 7)
        return [lead + 8, *digits[: 8 - lead]]
    return [0, *digits]


def encode_linear(values: np.ndarray) -> bytes:
    """Scale (big-endian double), two whole values, then residuals of linear extrapolation in half bytes."""
    values = np.asarray(values, np.float64)
    scale = fixed_point(values)
    out = struct.pack(">d", scale)
    whole = np.rint(values * scale).astype(np.int64).tolist()
    out += b"".join(struct.pack("<I", v & 0xFFFFFFFF) for v in whole[:2])
    half: list[int] = []
    for k in range(2, len(whole)):
        half += nibbles_of(whole[k] - (2 * whole[k - 1] - whole[k - 2]))
    if len(half) % 2:
        half.append(0)
    return out + bytes(a << 4 | b for a, b in zip(half[::2], half[1::2], strict=True))


def decode_linear(data: bytes) -> np.ndarray:
    """The inverse up to the scale's resolution."""
    if len(data) < 8:
        return np.zeros(0)
    scale = struct.unpack(">d", data[:8])[0]
    whole = [struct.unpack("<i", data[k : k + 4])[0] for k in range(8, min(len(data), 16), 4)]
    half = [h for b in data[16:] for h in (b >> 4, b & 15)]
    k = 0
    while k < len(half):
        head = half[k]
        if head == 0 and k + 1 >= len(half):  # padding
            break
        n = 8 - head if head <= 8 else 16 - head
        if k + 1 + n > len(half):
            break
        u = sum(d << (4 * i) for i, d in enumerate(half[k + 1 : k + 1 + n]))
        if head > 8:
            u |= (0xFFFFFFFF << (4 * n)) & 0xFFFFFFFF
        residual = u - (1 << 32) if u >= 1 << 31 else u
        whole.append(2 * whole[-1] - whole[-2] + residual)
        k += 1 + n
    return np.array(whole, np.float64) / scale if scale else np.zeros(0)


def decode_slof(data: bytes) -> np.ndarray:
    """Short logged floats: a scale (big-endian double), then exp(x / scale) - 1 of each little-endian 16-bit number x."""
    if len(data) < 8 or len(data) % 2:
        raise ValueError("short logged floats need a scale and whole 16-bit numbers")
    scale = struct.unpack(">d", data[:8])[0]
    return np.exp(np.frombuffer(data, "<u2", offset=8) / scale) - 1


def decode_pic(data: bytes) -> np.ndarray:
    """Positive integers in half bytes, as nibbles_of writes them."""
    half = [h for b in data for h in (b >> 4, b & 15)]
    out, k = [], 0
    while k < len(half):
        head = half[k]
        if k + 1 == len(half) and head != 8:  # padding
            break
        n = 8 - head if head <= 8 else 16 - head
        if k + 1 + n > len(half):
            raise ValueError("the data end within a number")
        u = sum(d << (4 * i) for i, d in enumerate(half[k + 1 : k + 1 + n]))
        out.append(u | ((0xFFFFFFFF << (4 * n)) & 0xFFFFFFFF if head > 8 else 0))
        k += 1 + n
    return np.array(out, np.float64)


def encode_udf():
    """A column function: array<double> to bytes, in Arrow batches."""
    from pyspark.sql.functions import pandas_udf

    def encode(values: pd.Series) -> pd.Series:
        return values.map(lambda a: None if a is None else encode_linear(np.asarray(a, np.float64)))

    return pandas_udf(encode, "binary")


def decode_udf():
    """A column function: bytes to array<double>, in Arrow batches."""
    from pyspark.sql.functions import pandas_udf

    def decode(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else decode_linear(b))

    return pandas_udf(decode, "array<double>")
