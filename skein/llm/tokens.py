"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Byte-level BPE for many languages; any file of ranks in this form will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the published pre-tokenisation of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(documents: DataFrame, ident: str, text: str, carry: tuple[str, ...] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """``ident``, the columns in ``carry`` and ``n_tokens`` of the whole text; null and empty texts have 0.

    The file of ``vocabulary`` goes to the executors with the job.
    """
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    @F.pandas_udf(T.LongType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(SparkFiles.get(name)).encode_ordinary
        for batch in texts:
            yield pd.Series([len(encode(t)) if t else 0 for t in batch], dtype="int64")

    return documents.select(ident, *carry, count(F.col(text)).alias("n_tokens"))
