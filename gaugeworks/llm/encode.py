"""Encoding of texts with a public byte-level BPE tokenizer, cut at forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token can never be
bridged by a merge, so each such pair marks a certain cut. A cut is used where it
also leaves the split pattern of the tokenizer unchanged on both sides: before it
stands an ASCII character that isn't white space, after it begins a character that
isn't an apostrophe. The fragments are encoded independently, each distinct one
once per worker, and their ids are concatenated.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.runtime import spread

#: Where the vocabulary lies; a parameter of every function that needs it.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rank files are a few MB at most; larger ones aren't sent to the workers.
RANKS_LIMIT = 64_000_000
#: Fragments that a worker remembers, and the longest that it does.
MEMO, MEMO_BYTES = 300_000, 64
#: Bytes of text whose ids are put out at once.
OUT_BYTES = 4_000_000


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Encoder:
    """Encodes buffers of UTF-8 text with one vocabulary."""

    def __init__(self, data: bytes):
        import tiktoken

        ranks = parse_ranks(data)
        self._whole = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        inside = np.zeros((256, 256), bool)
        for token in ranks:
            b = np.frombuffer(token, np.uint8)
            inside[b[:-1], b[1:]] = True
        before = np.zeros(256, bool)
        before[:128] = True
        before[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = False
        after = np.ones(256, bool)
        after[0x80:0xC0] = False
        after[ord("'")] = False
        self._cut = (~inside & before[:, None] & after[None, :]).ravel()
        self._memo: dict[bytes, list[int]] = {}

    def cuts(self, text: np.ndarray) -> np.ndarray:
        """Offsets in a buffer at which a fragment certainly begins."""
        if len(text) < 2:
            return np.zeros(0, np.int64)
        pair = text[:-1].astype(np.int32) << 8 | text[1:]
        return np.flatnonzero(self._cut[pair]) + 1

    def _fragment(self, piece: bytes) -> list[int]:
        found = self._whole.encode_ordinary(piece.decode("utf-8"))
        if len(piece) <= MEMO_BYTES:
            if len(self._memo) >= MEMO:
                self._memo.clear()
            self._memo[piece] = found
        return found

    def encode(self, text: bytes) -> list[int]:
        """Ids of one text."""
        return self.encode_many(text, np.array([0, len(text)], np.int64))[0]

    def encode_many(self, data: bytes, offsets: np.ndarray) -> list[list[int]]:
        """Ids of the texts between the offsets of one buffer. Cuts across two texts are
        harmless: the ends of a text are fragment ends in any case."""
        cuts = self.cuts(np.frombuffer(data, np.uint8))
        bounds = np.searchsorted(cuts, offsets)
        out, memo = [], self._memo
        for k in range(len(offsets) - 1):
            start, end = int(offsets[k]), int(offsets[k + 1])
            ids: list[int] = []
            if start < end:
                for stop in [*cuts[bounds[k] : bounds[k + 1]].tolist(), end]:
                    if stop > start:
                        piece = data[start:stop]
                        ids += memo.get(piece) or self._fragment(piece)
                        start = stop
            out.append(ids)
        return out


_LOADED: dict[str, Encoder] = {}


def shared_encoder(spark: SparkSession, path: str):
    """A function that gives the encoder of a rank file, built once per worker. The file is
    broadcast after a check of its size."""
    data = Path(path).read_bytes()
    if len(data) > RANKS_LIMIT:
        raise ValueError(f"{path} is too large for a vocabulary")
    key, shared = hashlib.sha1(data).hexdigest(), spark.sparkContext.broadcast(data)

    def load() -> Encoder:
        if key not in _LOADED:
            _LOADED[key] = Encoder(shared.value)
        return _LOADED[key]

    return load


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """A column in runs of rows of about OUT_BYTES: first row, last row, bytes, offsets."""
    column = column.cast(pa.large_string()).fill_null("")
    size = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(size, size[start] + OUT_BYTES, "right")) - 1)
        stop = min(stop, len(column))
        chunk = data[int(size[start]) : int(size[stop])].to_pybytes() if data is not None and size[stop] > size[start] else b""
        yield start, stop, chunk, size[start : stop + 1] - size[start]
        start = stop


def encode(df: DataFrame, row_id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(row_id, ids) of each row: token ids without special tokens.

    Null, and empty text, give an empty list. Blank and very long texts are encoded whole;
    the strings of special tokens are ordinary text. Repeated rows are encoded again.
    """
    load = shared_encoder(df.sparkSession, tokenizer)
    source = spread(df.select(F.col(row_id).alias("rec"), F.col(text).alias("text")), "rec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load()
        for batch in batches:
            for start, stop, data, offsets in _pieces(batch.column(1)):
                found = enc.encode_many(data, offsets)
                ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                flat = np.fromiter((i for x in found for i in x), np.int32, int(ends[-1]))
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0)[start:stop], ids], ["rec", "ids"])

    kind = source.schema["rec"].dataType.simpleString()
    return source.mapInArrow(run, f"rec {kind}, ids array<int>").withColumnRenamed("rec", row_id)


def count_tokens(df: DataFrame, row_id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(row_id, n_tokens) of each row, counted as by :func:`encode`."""
    load = shared_encoder(df.sparkSession, tokenizer)
    source = spread(df.select(F.col(row_id).alias("rec"), F.col(text).alias("text")), "rec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load()
        for batch in batches:
            n = [len(x) for _, _, data, offsets in _pieces(batch.column(1)) for x in enc.encode_many(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["rec", "n_tokens"])

    kind = source.schema["rec"].dataType.simpleString()
    return source.mapInArrow(run, f"rec {kind}, n_tokens bigint").withColumnRenamed("rec", row_id)
