"""Text building and lexicon scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.timestamps import pin

#: A small default lexicon of market language; pass your own for real use.
LEXICON = {
    "rose": 2.0, "jumped": 2.5, "safe": 1.8, "agreed": 1.2, "fixes": 1.5, "growing": 1.4, "joined": 0.8, "earned": 1.6, "calm": 1.3, "reopened": 1.7, "released": 0.9, "adds": 1.0,
    "slipped": -2.0, "halt": -1.8, "hacked": -3.0, "lost": -2.2, "broken": -2.4, "outage": -2.1, "offline": -1.9, "cut": -1.1, "paused": -1.6, "slippage": -1.2, "delays": -1.7, "fell": -1.5, "down": -1.3, "slides": -2.0, "thin": -0.8, "weaker": -1.4, "bug": -1.5,
}


def lexicon_hits(text: Column, lexicon: dict[str, float]) -> Column:
    """Array of the lexicon values of the words found; one regular expression visits the text once."""
    words = "|".join(sorted(lexicon))
    values = F.create_map(*[F.lit(x) for kv in sorted(lexicon.items()) for x in kv])
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"\b({words})\b"), F.lit(1))
    return F.transform(found, lambda w: values[w])


def with_lexicon_scores(df: DataFrame, text: str, lexicon: dict[str, float] | None = None, alpha: float = 15.0) -> DataFrame:
    """Add ``compound`` and ``polarity`` (see below); the text is searched once for both."""
    d = pin(df, {"__hits": lexicon_hits(F.col(text), lexicon or LEXICON)})
    d = pin(d, {"__s": F.aggregate("__hits", F.lit(0.0), lambda a, x: a + x)})
    mean = F.when(F.size("__hits") > 0, F.col("__s") / F.size("__hits") / 3.0).otherwise(F.when(F.col(text).isNotNull(), 0.0))
    return d.withColumns({"compound": F.col("__s") / F.sqrt(F.col("__s") * F.col("__s") + alpha), "polarity": mean}).drop("__hits", "__s")


def lexicon_compound(text: Column, lexicon: dict[str, float] | None = None, alpha: float = 15.0) -> Column:
    """Sum of word values squeezed into (-1, 1) by s / sqrt(s^2 + alpha); 0 without hits, NULL for NULL."""
    s = F.aggregate(lexicon_hits(text, lexicon or LEXICON), F.lit(0.0), lambda a, x: a + x)
    return s / F.sqrt(s * s + alpha)


def lexicon_polarity(text: Column, lexicon: dict[str, float] | None = None) -> Column:
    """Mean value of the words found, scaled by 3; 0 without hits."""
    hits = lexicon_hits(text, lexicon or LEXICON)
    total = F.aggregate(hits, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(hits) > 0, total / F.size(hits) / 3.0).otherwise(F.when(text.isNotNull(), 0.0))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def joined_text(headline: Column, snippet: Column, cut: int | None = None) -> Column:
    """``headline. snippet`` with NULL as empty."""
    text = stripped(F.concat(F.coalesce(headline, F.lit("")), F.lit(". "), F.coalesce(snippet, F.lit(""))))
    return F.substring(text, 1, cut) if cut else text


def joined_text_once(headline: Column, snippet: Column, cut: int | None = None) -> Column:
    """The same, but the headline alone if the snippet only repeats it."""
    same = stripped(F.coalesce(headline, F.lit(""))) == stripped(F.coalesce(snippet, F.lit("")))
    text = F.when(same, stripped(F.coalesce(headline, F.lit("")))).otherwise(joined_text(headline, snippet))
    return F.substring(text, 1, cut) if cut else text


def decay_weight(days: Column, half_life: float) -> Column:
    """exp(-ln 2 / half_life * days), days below 0 counting as 0."""
    return F.exp(-F.ln(F.lit(2.0)) / half_life * F.greatest(days, F.lit(0)))


def weighted_mean(x: Column, w: Column) -> Column:
    """Over rows where both are known; NULL without any."""
    both = x.isNotNull() & w.isNotNull()
    return F.sum(F.when(both, x * w)) / F.sum(F.when(both, w))
