"""Encoding of a corpus by a public byte-level BPE, with tiktoken and a local rank file.

Texts longer than ``piece_chars`` are cut where the splitting pattern itself must cut, so that ids are those of the whole text: before a single
space between two other characters, after a single line break or tab between two, and between a letter, a digit and any other sign that follow each other (not after an apostrophe, which
may begin a short form). An unbroken run of letters, digits or signs is one unit of the pattern and is never cut. The ids of the pieces follow each other. Decoding joins the raw bytes of all ids before they are read as UTF-8, as one character may span ids.

Null and empty texts give the empty list; blank texts are ordinary texts. Special tokens' strings are ordinary text.
The rank file is read on the driver and broadcast: its size is fixed by the vocabulary (below 1 MB here), and checked.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_RANK_BYTES = 64 * 1024 * 1024
# Fixed value: the splitting pattern published with the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Places where every alternative of the pattern ends, whatever stands further on, and where a text that ends there ends the same way.
_SAFE = regex.compile(r"(?<=\S)(?= \S)|(?<=\S[^\S ])(?=\S)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")


def safe_pieces(text: str, piece_chars: int) -> Iterator[str]:
    """Pieces of at least ``piece_chars`` (but the last), each ending where the pattern ends in any case."""
    start = 0
    while len(text) - start > piece_chars:
        at = _SAFE.search(text, start + piece_chars)
        if at is None:
            break
        yield text[start : at.start()]
        start = at.start()
    yield text[start:]


def load_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def _encoding(raw: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=load_ranks(raw), special_tokens={})


def _rank_bytes(spark: SparkSession, path: str):
    if os.path.getsize(path) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_BYTES} bytes")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, key: str, text: str, ranks: str = DEFAULT_RANKS, pattern: str = PATTERN, piece_chars: int = 65_536, out: str = "ids") -> DataFrame:
    raw = _rank_bytes(docs.sparkSession, ranks)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoding(raw.value, pattern)
        for batch in batches:
            yield batch.map(lambda t: [] if not t else [i for p in safe_pieces(t, piece_chars) for i in enc.encode_ordinary(p)])

    return docs.select(key, ids(F.col(text)).alias(out))


def decode(tokens: DataFrame, key: str, ids: str = "ids", ranks: str = DEFAULT_RANKS, pattern: str = PATTERN, out: str = "text") -> DataFrame:
    """The texts of lists of ids; null lists give null, empty ones ''."""
    raw = _rank_bytes(tokens.sparkSession, ranks)

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        back = {i: b for b, i in load_ranks(raw.value).items()}
        for batch in batches:
            yield batch.map(lambda x: None if x is None else b"".join(back[int(i)] for i in x).decode("utf-8", errors="replace"))

    return tokens.select(key, read(F.col(ids)).alias(out))
