"""Seeded draws of `operators.quantiles.uniform` for many rows and replicates at once: MD5 digits by numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

_TURN = [n for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for n in turns * 4]
_ADD = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_AT = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *((7 * i) % 16 for i in range(16))]
_BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes of a message that fit one block.
_MOST = 55


def _digits(blocks: np.ndarray) -> np.ndarray:
    """First 52 bits of the MD5 of padded blocks of 16 words, given as (16, n)."""
    a, b, c, d = (np.full(blocks.shape[1], v, np.uint32) for v in _BEGIN)
    for i in range(64):
        if i < 16:
            f = d ^ (b & (c ^ d))
        elif i < 32:
            f = c ^ (d & (b ^ c))
        elif i < 48:
            f = b ^ c ^ d
        else:
            f = c ^ (b | ~d)
        f += a
        f += blocks[_AT[i]]
        f += _ADD[i]
        turn = _TURN[i]
        a, d, c, b = d, c, b, b + ((f << np.uint32(turn)) | (f >> np.uint32(32 - turn)))
    high, low = (a + np.uint32(_BEGIN[0])).byteswap(), (b + np.uint32(_BEGIN[1])).byteswap()
    return (high.astype(np.uint64) << np.uint64(20)) | (low >> np.uint32(12))


def uniforms(seed: int, keys: pa.Array, replicates: Sequence[int]):
    """For each replicate the numbers in [0, 1) of rows by their keys' text, null being empty: what `uniform` gives for
    (seed, key, replicate)."""
    raw = keys.cast(pa.binary()).fill_null(b"")
    begun = b"%d:" % seed
    ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64) if len(raw) else np.zeros(1, np.int64)
    size = np.diff(ends)
    if size.max(initial=0) + len(begun) + 1 + max((len(str(r)) for r in replicates), default=0) > _MOST:
        texts = [b"%s%s:" % (begun, k) for k in raw.to_pylist()]
        for r in replicates:
            tail = str(r).encode()
            yield np.array([int(hashlib.md5(t + tail, usedforsecurity=False).hexdigest()[:13], 16) for t in texts], float) / 2.0**52
        return
    text = np.zeros((len(raw), 64), np.uint8)
    text[:, : len(begun)] = np.frombuffer(begun, np.uint8)
    row = np.repeat(np.arange(len(raw)), size)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    text[row, len(begun) + np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], size)] = data[ends[0] : ends[-1]]
    rows, at = np.arange(len(raw)), len(begun) + size
    text[rows, at] = ord(":")
    at = at + 1
    for r in replicates:
        own, tail = text.copy(), str(r).encode()
        for k, byte in enumerate(tail + b"\x80"):
            own[rows, at + k] = byte
        bits = ((at + len(tail)) * 8).astype(np.uint16)
        own[:, 56], own[:, 57] = bits & 255, bits >> 8
        yield _digits(np.ascontiguousarray(own.view("<u4").T)).astype(float) / 2.0**52


def grouped(batch: pa.RecordBatch, by: Sequence[str]) -> tuple[np.ndarray, pa.Array]:
    """Each row's group among those of its batch, and a row of each group."""
    if not by or not batch.num_rows:
        return np.zeros(batch.num_rows, int), pa.array([0][: batch.num_rows], pa.int64())
    codes = np.zeros(batch.num_rows, int)
    for c in by:
        own = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
        codes = np.unique(codes * (int(own.max()) + 1) + own, return_inverse=True)[1]
    return codes, pa.array(np.unique(codes, return_index=True)[1])
