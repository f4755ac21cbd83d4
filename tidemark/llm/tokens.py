"""Sizes of texts in tokens of a public subword tokenizer."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import ship


def default_vocabulary() -> str:
    """Path of the byte-level BPE ranks of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=4)
def encoder(vocabulary: str):
    """The tokenizer of a rank file, read once per Python worker."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the size of the whole text.

    ``vocabulary`` is the path of a rank file that all workers can open; without one, each takes
    that of its own installed tokenizers.

    A null or empty text has 0 tokens; strings that name special tokens are ordinary text.  Texts
    go through Arrow batches once and aren't shuffled.
    """
    ship(docs.sparkSession)
    out = T.StructType([docs.schema[c] for c in keep] + [T.StructField("tokens", T.LongType(), False)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary or default_vocabulary()).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], pa.array(sizes, pa.int64())], names=[*keep, "tokens"]
            )

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(count, out)
