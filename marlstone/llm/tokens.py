"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

def default_tokenizer() -> str:
    """Path of the byte-level BPE ranks of the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@functools.cache
def _counter(path: str) -> Callable[[str], int]:
    """Token count of a text by the file's own library: ranks (.tiktoken), .json or sentencepiece (.model)."""
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda text: len(encode(text))
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: len(t.encode(text, add_special_tokens=False))


def token_counts(texts: list[str | None], path: str) -> list[int]:
    """Number of tokens of each text; NULL has none. The whole text counts, however long."""
    count = _counter(path)
    return [count(x) if x else 0 for x in texts]


def n_tokens(text: Column, path: str | None = None) -> Column:
    """Tokens of a text column, as INT; 0 for NULL and empty texts.

    Declared as not deterministic, though it is: the optimizer would otherwise copy it into a filter
    on its result and count every text twice.
    """
    path = path or default_tokenizer()

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(token_counts([t if isinstance(t, str) else None for t in texts], path), dtype="int32")

    return count.asNondeterministic()(text)
