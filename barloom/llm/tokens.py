"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

#: The vocabulary file (ranks of byte-level BPE); a parameter of every operator, never copied.
VOCABULARY = os.environ.get("BARLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")

#: Fixed value: how byte-level BPE of this family cuts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column | str, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of the whole text; 0 for null and empty. Strings that name special tokens are ordinary text."""

    @F.pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(vocabulary)
        for part in parts:
            yield part.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int64")

    return run(F.col(text) if isinstance(text, str) else text)
