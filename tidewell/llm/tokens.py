"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rank file of a byte-level BPE vocabulary; a parameter, never copied.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict = {}


def encoding(path: str, pattern: str):
    """The encoder, loaded once in each worker."""
    if (path, pattern) not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path, pattern]


def with_tokens(docs: DataFrame, *, text_column: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``docs`` with the text replaced by ``n_tokens``; null and empty texts have none."""
    rest = [c for c in docs.columns if c != text_column]
    schema = docs.select(*rest, F.lit(0).cast("long").alias("n_tokens")).schema

    def count(batches):
        encode = encoding(tokenizer, pattern).encode_ordinary
        for batch in batches:
            texts = batch.column(len(rest)).to_pylist()
            sizes = pa.array([len(encode(t)) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), sizes], names=[*rest, "n_tokens"])

    return docs.select(*rest, text_column).mapInArrow(count, schema)
