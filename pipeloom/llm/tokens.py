"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabulary files lie on every machine; a parameter of all token operators.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts longer than this are encoded in parts.
CHUNK = 100_000
#: A place that the split pattern always cuts at: after a letter or digit, before a blank that a letter or digit follows.
_BORDER = re.compile(r"(?<=[^\W_])(?= [^\W_])")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = TOKENIZER) -> int:
    """Tokens of the whole text; 0 for NULL."""
    if not text:
        return 0
    enc, n, start = _encoding(path), 0, 0
    while start < len(text):
        border = _BORDER.search(text, start + CHUNK) if len(text) - start > CHUNK else None
        end = border.start() if border else len(text)  # text without such a place is encoded as a whole
        n += len(enc.encode_ordinary(text[start:end].encode("utf-8", "replace").decode()))
        start = end
    return n


def token_counts(df: DataFrame, ident: str, text: str, *carry: Column, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, carry..., tokens) for every row of ``df``; NULL text has 0 tokens."""
    cols = df.select(F.col(ident).alias("doc_id"), *carry, F.col(text).alias("_text"))
    kept = [f for f in cols.schema.fields if f.name != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array([count_tokens(t, path) for t in batch.column("_text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [sizes], [f.name for f in kept] + ["tokens"])

    return cols.mapInArrow(run, T.StructType([*kept, T.StructField("tokens", T.LongType())]))
