"""Writers and report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """CSV with a header; ``files`` bounds the number of files for small results, else each task writes its own."""
    (df.coalesce(files) if files else df).write.mode("overwrite").option("header", True).csv(path)


def fixed_width(*cells: tuple[Column, int]) -> Column:
    """One line of right-aligned text cells of the given widths; NULL is a dash."""
    return F.concat_ws(" ", *[F.lpad(F.coalesce(c, F.lit("-")), width, " ") for c, width in cells])


def number(c: Column, decimals: int = 4) -> Column:
    return F.round(c, decimals).cast(f"decimal(20,{decimals})").cast("string")
