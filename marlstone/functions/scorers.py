"""Text scorers that hold a model: loaded once per worker, fed in batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def model_score(text: Column, load: Callable[[], Callable[[list[str]], list[tuple[float, float]]]], batch: int = 32) -> Column:
    """P(positive) - P(negative) by a model that ``load`` returns; NULL texts score NULL.

    The model maps a list of texts to (positive, negative) logits, with a neutral one at zero. ``load``
    runs once per Python worker and stream of batches; any library it imports stays optional.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            out: list[float | None] = []
            for at in range(0, len(texts), batch):
                part = texts.iloc[at : at + batch]
                for t, (pos, neg) in zip(part, model(["" if t is None else t for t in part])):
                    top = max(pos, neg, 0.0)
                    p, n, z = math.exp(pos - top), math.exp(neg - top), math.exp(-top)
                    out.append(None if t is None else (p - n) / (p + n + z))
            yield pd.Series(out, dtype="float64")

    return score(text)


def lexicon_model(lexicon: dict[str, float]) -> Callable[[], Callable[[list[str]], list[tuple[float, float]]]]:
    """A model of word sums, the default where no trained one is at hand."""

    def load() -> Callable[[list[str]], list[tuple[float, float]]]:
        import re

        words = re.compile(r"\b(" + "|".join(sorted(lexicon)) + r")\b")

        def logits(texts: list[str]) -> list[tuple[float, float]]:
            hits = [[lexicon[w] for w in words.findall(t.lower())] for t in texts]
            return [(sum(v for v in h if v > 0), -sum(v for v in h if v < 0)) for h in hits]

        return logits

    return load
