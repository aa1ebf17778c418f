"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

#: Fixed value: the published splitting pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = os.environ.get("RXLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


@lru_cache(2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows with n_tokens for their text instead of it; a null text has null, an empty one 0."""
    others = [f for f in docs.schema.fields if f.name not in ("text", "n_tokens")]
    schema = StructType([*others, StructField("n_tokens", LongType())])
    docs = docs.select(*[f.name for f in others], "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for b in batches:
            n = [None if t is None else len(enc.encode_ordinary(t.encode("utf-8", "replace").decode())) for t in b.column("text").to_pylist()]
            cols = [b.column(f.name) for f in others]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64())], names=[*(f.name for f in others), "n_tokens"])

    return docs.mapInArrow(run, schema)


__all__ = ["VOCABULARY", "with_token_counts"]
