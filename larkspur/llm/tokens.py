"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LONG = 50_000
_encodings: dict[str, object] = {}


def encoding(path: str = RANKS):  # noqa: ANN201
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def count(text: str, path: str = RANKS) -> int:
    """Tokens of a text; one without white space for a very long stretch is counted in stretches of 50,000 characters."""
    encode = encoding(path).encode_ordinary
    if len(text) <= _LONG:
        return len(encode(text))
    total = 0
    for part in re.findall(r"\s*\S+\s*", text) if max(map(len, text.split()), default=0) > _LONG else [text]:
        total += sum(len(encode(part[i : i + _LONG])) for i in range(0, len(part), _LONG)) if len(part) > _LONG and part is not text else len(encode(part))
    return total


def with_counts(df: DataFrame, text: str, path: str = RANKS) -> DataFrame:
    """df without its text, with `tokens` (0 for null or empty texts) and `text_hash` (null for those)."""
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [count(t, path) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.record_batch([*batch.columns[1:], pa.array(n, pa.int64())], names=[*keep, "text_hash", "tokens"])

    hashed = F.when(F.col(text) != "", F.sha2(F.col(text), 256)).alias("text_hash")
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text_hash string", "tokens long"])
    return df.select(F.col(text), *[F.col(c) for c in keep], hashed).mapInArrow(run, schema)
