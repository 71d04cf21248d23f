"""Token counts with a public tokenizer, as an Arrow UDF.

The vocabulary is a parameter and is read where the tasks run; it is never part of the
repository. Very long texts are encoded whole, in pieces that break where a blank follows a letter or digit,
which is where the tokenizer's own pattern breaks as well; a text without such a place is encoded in one piece.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

#: One of the byte-level vocabularies for many languages; a full path may be given instead.
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Length of the pieces; they keep the encoder's memory small. A run without a blank is never cut.
PIECE = 20_000

_BREAK = re.compile(r"[^\W_] (?=\S)")
_LOADED: dict[str, Callable[[str], int]] = {}


def _counter(name: str) -> Callable[[str], int]:
    if name not in _LOADED:
        import base64
        import os

        import public_tokenizers
        import tiktoken

        path = name if os.path.isabs(name) else public_tokenizers.path(name)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def count(text: str) -> int:
            text = text.encode("utf-8", "replace").decode("utf-8")
            return sum(len(encoding.encode_ordinary(part)) for part in _parts(text))

        _LOADED[name] = count
    return _LOADED[name]


def _parts(text: str) -> Iterator[str]:
    """``text`` in pieces of at least ``PIECE`` characters that start at a blank after a letter or digit."""
    start = 0
    while len(text) - start > PIECE:
        found = _BREAK.search(text, start + PIECE)
        if not found:
            break
        yield text[start : found.end() - 1]
        start = found.end() - 1
    yield text[start:]


def n_tokens(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Tokens of the whole text; 0 for NULL and empty text."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(tokenizer)
        for batch in batches:
            yield pd.Series([counter(t) if t else 0 for t in batch], dtype="int32")

    return count(text)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
