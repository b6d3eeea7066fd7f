"""Sizes of texts in tokens of a public byte-pair tokenizer."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.runtime import fresh

#: Ranks of a byte-level vocabulary, as lines of base64 and a number. Only the driver reads the file.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: The pattern that texts are cut by before pairs are merged (a fixed value of this vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A vocabulary that is larger is not sent to the executors.
MOST_BYTES = 16 << 20

_ENCODINGS: dict[str, object] = {}


def _encoding(data: bytes) -> object:
    """One encoding for each vocabulary that a Python worker has met."""
    import tiktoken

    key = hashlib.sha256(data).hexdigest()
    if key not in _ENCODINGS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _ENCODINGS[key] = tiktoken.Encoding(key, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def token_counter(data: bytes) -> Callable[[str | None], int]:
    """Tokens of a text; 0 of a missing one. A very long text is encoded whole."""
    encode = _encoding(data).encode_to_numpy

    def count(text: str | None) -> int:
        return len(encode(text, disallowed_special=())) if text else 0

    return count


def with_token_counts(df: DataFrame, text: str, size: str, *, vocabulary: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of df and `size`, the tokens of `text`: 0 where it is empty or null. Strings that name special
    tokens are ordinary text. `size` is given another name if `keep` has one like it. The text itself goes no further."""
    keep = [c for c in df.columns if c != text] if keep is None else keep
    (size,) = fresh(keep, size)
    (body,) = fresh([*keep, size], "body")
    with open(vocabulary, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{vocabulary} has more than {MOST_BYTES} bytes")
    sent = df.sparkSession.sparkContext.broadcast(data)
    schema = df.select(*keep, F.lit(0).cast("bigint").alias(size)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(sent.value)
        for batch in batches:
            sizes = pa.array([count(t.as_py()) for t in batch.column(body)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), sizes], [*keep, size])

    return df.select(*keep, F.col(text).alias(body)).mapInArrow(run, schema)
