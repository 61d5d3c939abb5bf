"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Null texts count as empty. Texts of any length are encoded whole: beyond `long_text` code
points they are first cut at boundaries that no pre-split match can cross, so the pieces'
ids, put together, are the ids of the whole text. Runs of BLANKS or more blanks, on which the
library's matcher runs out of stack, are cut by the pattern's own rule and encoded as the one
match they are. Decoding gives the raw bytes, which need
not be valid UTF-8 when ids come from elsewhere. Rows, repeated or not, keep their own
results; empty tables give empty tables.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between visible ASCII and a blank, and between ASCII letters and digits: a match of the
#: pre-split pattern takes at most one blank, at its start, and never mixes letters and digits.
SAFE = re.compile(r"[!-~](?=[ \n])|[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")
LONG_TEXT = 20_000
#: The characters with the White_Space property.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS = 1000
BLANK_RUN = re.compile(f"[{WHITE}]{{{BLANKS},}}")


@cache
def encoding(rank_file: str, pattern: str):
    """The encoding of a rank file; one for each Python worker."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, long_text: int = LONG_TEXT) -> Iterator[str]:
    """text in parts of about long_text code points, cut only at safe boundaries."""
    start = 0
    while len(text) - start > long_text:
        cut = SAFE.search(text, start + long_text)
        if cut is None:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:] if start else text


def encode_text(text: str | None, rank_file: str, pattern: str, long_text: int = LONG_TEXT) -> list[int]:
    own = encoding(rank_file, pattern)
    if not text:
        return []
    if len(text) <= long_text:
        return own.encode_ordinary(text)
    ids, start = [], 0
    for run in BLANK_RUN.finditer(text):
        # All of a run but its last blank is one match, or all of it at the end of the text: \s+(?!\S).
        end = run.end() - (run.end() < len(text))
        ids += _encode_stretch(text[start : run.start()], own, long_text)
        ids += own._encode_single_piece(text[run.start() : end])
        start = end
    return ids + _encode_stretch(text[start:], own, long_text)


def _encode_stretch(text: str, own, long_text: int) -> list[int]:
    return [i for piece in pieces(text, long_text) for i in own.encode_ordinary(piece)]


def encode(text: Column, rank_file: str, pattern: str, long_text: int = LONG_TEXT) -> Column:
    """The ids of a text as little-endian unsigned 32-bit integers, a binary column."""

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(encode_text(t, rank_file, pattern, long_text), "<u4").tobytes() for t in texts], dtype=object)

    return ids(text)


def decode(ids: Column, rank_file: str, pattern: str) -> Column:
    """The raw bytes of ids as encode() gives them; null ids count as none."""

    @F.pandas_udf("binary")
    def raw(column: pd.Series) -> pd.Series:
        own = encoding(rank_file, pattern)
        return pd.Series([own.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in column], dtype=object)

    return raw(ids)


def id_array(ids: Column) -> Column:
    """Ids as an array column, for readers that want integers."""

    @F.pandas_udf("array<int>")
    def unpack(column: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x or b"", "<u4").astype(np.int32) for x in column], dtype=object)

    return unpack(ids)


def token_count(ids: Column) -> Column:
    return F.expr("0L") + (F.coalesce(F.octet_length(ids), F.lit(0)) / 4).cast("long")
