"""Problem 7: encoding a corpus with a public byte-level BPE tokenizer.

Method: the tiktoken library with a local rank file. Long texts are first split at safe
boundaries (places where the tokenizer's own pattern always starts a new piece), so that no single
call grows with the text; each part is encoded and the ids are concatenated, which gives exactly
the ids of the whole text.

Defined results: a null and an empty text give an empty list of ids, a blank text is encoded as it
is; one output row per input row; other columns are not carried and may have any names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the public vocabulary files lie on this machine; pass another folder on a cluster.
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-splitting pattern that belongs to the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts longer than this many characters are encoded in parts.
PART_CHARS = 1 << 16

# A white-space character after anything else starts a new piece of the pattern, whatever follows.
_SAFE = re.compile(r"(?<=\S)(?=\s)")
_encodings: dict[str, object] = {}


def encoding(ranks_path: str = DEFAULT_RANKS):
    """The tokenizer of a rank file, built once per Python process."""
    if ranks_path not in _encodings:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encodings[ranks_path] = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[ranks_path]


def safe_parts(text: str, limit: int = PART_CHARS) -> Iterator[str]:
    """`text` in consecutive parts, each cut at the first safe boundary at or after `limit` characters."""
    start = 0
    while len(text) - start > limit:
        m = _SAFE.search(text, start + limit)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def encode(text: str | None, ranks_path: str = DEFAULT_RANKS, limit: int = PART_CHARS) -> list[int]:
    """The ids of one text, without special tokens."""
    if not text:
        return []
    enc = encoding(ranks_path)
    if len(text) <= limit:
        return enc.encode_ordinary(text)
    return [i for part in safe_parts(text, limit) for i in enc.encode_ordinary(part)]


def decode_bytes(ids: list[int], ranks_path: str = DEFAULT_RANKS) -> bytes:
    """The raw bytes of a list of ids; concatenating decoded lists is safe even inside a character."""
    return encoding(ranks_path).decode_bytes(list(ids))


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """(id_col, ids): the token ids of every row, in one map over the table without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.asarray(encode(t, ranks_path), dtype=np.int32) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, lists)], dtype=np.int64).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.empty(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """(id_col, n_tokens): the number of token ids of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(encode(t, ranks_path)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=[id_col, "n_tokens"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint")
