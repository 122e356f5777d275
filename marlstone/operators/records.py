"""Delimited records: load the valid ones, set the others apart with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.timestamps import parse_dates, pin
from marlstone.session import durable, small_side

_BLANK = r"^[\s\u0085\p{Z}\u200b\ufeff]*$"


def is_blank(column: Column) -> Column:
    return F.coalesce(column, F.lit("")).rlike(_BLANK)


def split_fields(df: DataFrame, line: str, delimiter: str = "\t", fields: int = 2) -> DataFrame:
    """Add ``__n`` (fields found), ``__bad`` (a quoted field is not well formed) and ``__f1..`` (contents).

    A field is quoted only if it begins with a double quote; it ends at a lone quote directly before
    the delimiter or the end and writes a quote as two. The line is cut at every delimiter, and a
    fold over the pieces carries whether a quoted field is still open, so any number of fields, of
    delimiters inside quotes and of line breaks is read in one pass without backtracking.
    """
    marked = lambda s: F.replace(s, F.lit('""'), F.lit(""))  # noqa: E731  pairs first, from the left
    q = F.lit('"')
    piece = lambda x: F.when(x.startswith('"'), F.substring(x, 2, 2147483647)).otherwise(x)

    def step(acc: Column, x: Column) -> Column:
        starts = ~acc["open"]
        quoted = acc["open"] | x.startswith('"')
        body = marked(F.when(acc["open"], x).otherwise(piece(x)))
        at = F.when(quoted, F.instr(body, '"')).otherwise(F.lit(0))
        still = quoted & (at == 0)
        return F.struct(
            (acc["n"] + starts.cast("int")).alias("n"),
            still.alias("open"),
            (acc["bad"] | (at > 0) & (at < F.length(body))).alias("bad"),
            (acc["at"] + 1).alias("at"),
            F.when(~still & (acc["n"] + starts.cast("int") < fields), F.concat(acc["ends"], F.array(acc["at"] + 1))).otherwise(acc["ends"]).alias("ends"),
        )

    zero = F.struct(F.lit(0).alias("n"), F.lit(False).alias("open"), F.lit(False).alias("bad"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))
    d = pin(df, {"__p": F.split(F.col(line), F.lit(f"\\Q{delimiter}\\E"), -1)})
    d = pin(d, {"__s": F.aggregate("__p", zero, step)})
    s = F.col("__s")
    columns = {"__n": s["n"], "__bad": s["bad"] | s["open"]}
    good = (s["n"] == fields) & ~s["bad"] & ~s["open"]
    for k in range(fields):
        first = F.lit(1) if k == 0 else F.get(s["ends"], F.lit(k - 1)) + 1
        last = F.size("__p") if k == fields - 1 else F.get(s["ends"], F.lit(k))
        raw = F.array_join(F.slice("__p", first, last - first + 1), delimiter)
        inner = F.replace(F.substring(raw, 2, 2147483647), F.lit('""'), q)
        columns[f"__f{k + 1}"] = F.when(good, F.when(raw.startswith('"'), F.substring(inner, F.lit(1), F.length(inner) - 1)).otherwise(raw))
    return pin(d, columns).drop("__p", "__s")


def failed_values(df: DataFrame, date: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Dictionaries of the invalid values of the two columns, with reasons.

    Every distinct date is cast once; of the texts only those that a white-space test does not clear
    are candidates at all, so the corpus of texts is not shuffled for it. The rows are read once for
    both: their distinct values come out of one aggregate, and the dictionary is cut once.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    pair = lambda kind, v: F.struct(F.lit(kind).alias("k"), v.alias("v"))
    both = F.array(pair("date", F.coalesce(F.col(date), F.lit(""))), F.when(is_blank(t), pair("text", t)))
    values = df.select(F.inline(F.filter(both, lambda x: x.isNotNull()))).distinct()
    judged = parse_dates(values, "v", out="__d")
    why = F.when(F.col("k") == "text", "the text is blank").when(F.col("__d_kind") == "blank", "the date is blank").when(F.col("__d_kind") == "format", "no date notation fits").otherwise("no such day or moment")
    bad = durable(judged.filter((F.col("k") == "text") | ~F.col("__d_kind").isin("day", "moment")).select("k", F.col("v").alias("__v"), why.alias("__why")))
    part = lambda kind, name: bad.filter(F.col("k") == kind).select("__v", F.col("__why").alias(name))
    return part("date", "__why_date"), part("text", "__why_text")


def load_records(df: DataFrame, line: str = "line", key: str = "line_id") -> tuple[DataFrame, DataFrame]:
    """Split delivered two-field lines into ``(valid, failed)``.

    valid has the input's columns and ``date`` and ``text`` (quotes removed; extra input columns of
    these names are replaced); failed has ``key``, ``reason`` and ``detail``. reason is the first
    that applies: ``quoting``, ``columns``, ``value``. Blank and NULL lines are no records and come
    out in neither. Repeated lines count each by itself. An empty table gives two empty results.

    Structure is read per line in the JVM. Values are judged through dictionaries of the distinct
    invalid values (``failed_values``), joined back: broadcast if their size allows, else by shuffle.
    """
    d = split_fields(df.filter(F.col(line).isNotNull() & ~is_blank(F.col(line))), line)
    cells = d.filter(~F.col("__bad") & (F.col("__n") == 2))
    bad_dates, bad_texts = (small_side(x) for x in failed_values(cells, "__f1", "__f2"))
    d = d.join(bad_dates.withColumnRenamed("__v", "__v1"), F.coalesce("__f1", F.lit("")) == F.col("__v1"), "left")
    d = d.join(bad_texts.withColumnRenamed("__v", "__v2"), F.coalesce("__f2", F.lit("")) == F.col("__v2"), "left")
    reason = F.when(F.col("__bad"), "quoting").when(F.col("__n") != 2, "columns").when(F.col("__why_date").isNotNull() | F.col("__why_text").isNotNull(), "value")
    detail = (
        F.when(F.col("__bad"), "a quoted field is not well formed")
        .when(F.col("__n") != 2, F.concat(F.col("__n").cast("string"), F.lit(" fields instead of 2")))
        .otherwise(F.coalesce("__why_date", "__why_text"))
    )
    d = d.withColumns({"__reason": reason, "__detail": detail})
    extra = [c for c in df.columns if c not in ("date", "text")]
    valid = d.filter(F.col("__reason").isNull()).select(*[F.col(f"`{c}`") for c in extra], F.col("__f1").alias("date"), F.col("__f2").alias("text"))
    failed = d.filter(F.col("__reason").isNotNull()).select(F.col(key), F.col("__reason").alias("reason"), F.col("__detail").alias("detail"))
    return valid, failed
