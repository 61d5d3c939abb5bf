"""A bloom filter over the byte trigrams of log bodies, one for each block.

A probe answers "may contain" for a needle; it never misses one that is there. Needles of
fewer than three bytes cannot be told and always may.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAGIC = b"TLBF"


def geometry(n: int, p: float = 0.01) -> tuple[int, int]:
    """Bits and hashes for n entries at a rate of false positives within [1e-6, 0.5]."""
    if n <= 0:
        return 1, 1
    p = min(max(p, 1e-6), 0.5)
    bits = max(1, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    return bits, max(1, round(bits / n * math.log(2)))


def trigrams(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    return np.unique((b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]) if len(b) > 2 else np.empty(0, np.uint64)


def _places(grams: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    a = grams * np.uint64(0x9E3779B97F4A7C15)
    a ^= a >> np.uint64(32)
    b = (grams + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    b = (b ^ (b >> np.uint64(29))) | np.uint64(1)
    return (a[:, None] + np.arange(hashes, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


def build(grams: np.ndarray, p: float = 0.01) -> bytes:
    bits, hashes = geometry(len(grams), p)
    field = np.zeros(bits, bool)
    if len(grams):
        field[_places(grams, bits, hashes).ravel()] = True
    return MAGIC + struct.pack("<QI", bits, hashes) + np.packbits(field).tobytes()


def may_contain(blob: bytes | None, needle: str) -> bool:
    grams = trigrams(needle.encode())
    if blob is None or not len(grams):
        return True
    if blob[:4] != MAGIC:
        raise ValueError("not a bloom filter")
    bits, hashes = struct.unpack_from("<QI", blob, 4)
    field = np.unpackbits(np.frombuffer(blob, np.uint8, offset=16), count=bits)
    return bool(field[_places(grams, bits, hashes).ravel()].all())


def may_hold(blob: Column, needle: str) -> Column:
    """may_contain() for a column of blooms, asked where they are stored."""

    @F.pandas_udf("boolean")
    def asked(blobs: pd.Series) -> pd.Series:
        return pd.Series([may_contain(None if b is None else bytes(b), needle) for b in blobs], dtype=bool)

    return asked(blob)


def _grams_of(bodies) -> np.ndarray:
    """Distinct trigrams of many bodies, found over one buffer; those that would span two bodies are left out."""
    parts = [(b or "").encode() for b in bodies]
    b = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.uint64)
    ends = np.cumsum([len(x) for x in parts])
    whole = np.ones(len(b), bool)
    for back in (1, 2):
        whole[ends[ends >= back] - back] = False  # no trigram begins in the last two bytes of a body
    return np.unique(((b[:-2] << 16) | (b[1:-1] << 8) | b[2:])[whole[:-2]]).astype(np.uint64)


def build_blooms(rows: DataFrame, p: float = 0.01) -> DataFrame:
    """rows(block, body) -> (block, bloom).

    Trigrams are gathered in each task first, then a block's are joined one task's share after another;
    there are at most 2 ** 24 of them, so both are bounded however many bodies and tasks there are.
    Tasks without rows give nothing.
    """

    def gather(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for block, bodies in batch.groupby("block").body:
                grams = _grams_of(bodies)
                held[block] = np.union1d(held[block], grams) if block in held else grams
        if held:  # columns of an empty frame would be numbers, which Arrow refuses as text
            yield pd.DataFrame({"block": list(held), "grams": [g.astype("<u4").tobytes() for g in held.values()]})

    def finish(batches):
        name, grams = None, np.empty(0, np.uint64)
        for batch in batches:
            for block, part in zip(batch.block, batch.grams):
                if name is not None and block != name:
                    yield pd.DataFrame({"block": [name], "bloom": [build(grams, p)]})
                    grams = np.empty(0, np.uint64)
                name, grams = block, np.union1d(grams, np.frombuffer(part, "<u4").astype(np.uint64))
        if name is not None:
            yield pd.DataFrame({"block": [name], "bloom": [build(grams, p)]})

    gathered = rows.select("block", "body").mapInPandas(gather, "block string, grams binary")
    return gathered.repartition("block").sortWithinPartitions("block").mapInPandas(finish, "block string, bloom binary")
