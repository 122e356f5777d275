"""Totals and averages over trailing calendar periods, days without activity included."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.session import durable

#: Days in a time tile and entities in a block: a block holds about a megabyte of doubles.
TILE_DAYS = 256
BLOCK_ENTITIES = 128


def latest_readings(df: DataFrame, entity: str, day: str, values: list[str], loaded: str | None) -> DataFrame:
    """One row per (entity, day): of the rows whose first value is not NULL the one loaded last.

    Equal load times are decided by the larger values. Rows without entity or day have no place on
    the calendar and are left out. NaN and infinities count as NULL. The maximum is combined before the shuffle.
    """
    cast = [F.when(F.abs(F.col(v).cast("double")) < float("inf"), F.col(v).cast("double")).alias(f"__v{k}") for k, v in enumerate(values)]
    d = df.select(F.col(entity).alias("__e"), F.col(day).cast("date").alias("__day"), (F.col(loaded) if loaded else F.lit(None).cast("timestamp")).alias("__at"), *cast)
    d = d.filter(F.col("__e").isNotNull() & F.col("__day").isNotNull() & F.col("__v0").isNotNull())
    best = F.max(F.struct("__at", *[f"__v{k}" for k in range(len(values))])).alias("__best")
    return d.groupBy("__e", "__day").agg(best).select("__e", "__day", *[F.col(f"__best.__v{k}") for k in range(len(values))])


def trailing_totals(df: DataFrame, entity: str, day: str, values: list[str], spans: tuple[int, ...] = (7, 30), loaded: str | None = None, tile_days: int = TILE_DAYS, block_entities: int = BLOCK_ENTITIES) -> DataFrame:
    """For each entity and each day from its first to its last reading, over each trailing span.

    Result: ``entity``, ``day`` and per span s ``days_s`` (days with a reading), ``{v}_sum_s`` and
    ``{v}_avg_s`` per value v (NULL where the span holds no value). The span's last day is the day.
    See ``latest_readings`` for repeated, late and NULL rows; an empty table gives an empty result.

    Readings go to (block of entities, tile of days) groups; the last days of a tile go to the next
    one too, as its halo. A group is a dense entities x days block multiplied by banded 0/1 window
    matrices. A group holds at most block x (tile + halo) rows, so no entity can overload a task:
    a hot one spreads over its tiles after its repeats were combined.
    """
    halo = max(spans) - 1
    if tile_days < halo:
        raise ValueError("a tile must be at least as long as the longest span")
    readings = durable(latest_readings(df, entity, day, values, loaded))
    bounds = readings.groupBy("__e").agg(F.min("__day").alias("__first"), F.max("__day").alias("__last"))
    blocks = max(1, -(-bounds.count() // block_entities))
    tile = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / tile_days).cast("int")
    block = F.pmod(F.xxhash64("__e"), F.lit(blocks)).cast("int").alias("__block")
    vs = [f"__v{k}" for k in range(len(values))]
    number = F.datediff("__day", F.lit("1970-01-01"))
    ends = F.when(F.pmod(number, F.lit(tile_days)) >= tile_days - halo, F.array(tile(F.col("__day")), tile(F.col("__day")) + 1)).otherwise(F.array(tile(F.col("__day"))))
    rows = readings.select("__e", block, F.explode(ends).alias("__tile"), number.alias("__n"), *vs, F.lit(None).cast("int").alias("__lo"), F.lit(None).cast("int").alias("__hi"))
    spine = bounds.select(
        "__e", block, F.explode(F.sequence(tile(F.col("__first")), tile(F.col("__last")))).alias("__tile"), F.lit(None).cast("int").alias("__n"), *[F.lit(None).cast("double").alias(v) for v in vs],
        F.datediff("__first", F.lit("1970-01-01")).alias("__lo"), F.datediff("__last", F.lit("1970-01-01")).alias("__hi"),
    )
    fields = [T.StructField("entity", df.schema[entity].dataType), T.StructField("day_number", T.IntegerType())]
    for s in spans:
        fields.append(T.StructField(f"days_{s}", T.IntegerType()))
        fields += [T.StructField(f"{v}_{f}_{s}", T.DoubleType()) for v in values for f in ("sum", "avg")]
    width = tile_days + halo
    bands = {s: sum(np.eye(width, tile_days, k=-(halo - b)) for b in range(s)) for s in spans}

    def dense(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        start = int(key[1]) * tile_days
        own = pdf[pdf["__lo"].notna()]
        names = own["__e"].to_numpy()
        own_days = np.arange(start, start + tile_days)
        inside = (own_days >= own["__lo"].to_numpy()[:, None]) & (own_days <= own["__hi"].to_numpy()[:, None])
        who, when = np.nonzero(inside)
        seen = pdf[pdf["__n"].notna()]
        place = pd.Index(names).get_indexer(seen["__e"])
        seen, place = seen[place >= 0], place[place >= 0]
        col = seen["__n"].to_numpy().astype(int) - (start - halo)
        out: dict[str, np.ndarray] = {"entity": names[who], "day_number": own_days[when].astype(np.int32)}
        grid = np.zeros((len(names), width))
        grid[place, col] = 1
        stacks = []
        for v in vs:
            x = seen[v].to_numpy(dtype=float)
            held, total = np.zeros_like(grid), np.zeros_like(grid)
            held[place, col], total[place, col] = ~np.isnan(x), np.nan_to_num(x)
            stacks.append((held, total))
        for s in spans:
            out[f"days_{s}"] = np.rint((grid @ bands[s])[who, when]).astype(np.int32)
            for v, (held, total) in zip(values, stacks):
                n = np.rint((held @ bands[s])[who, when])
                t = (total @ bands[s])[who, when]
                with np.errstate(invalid="ignore", divide="ignore"):
                    out[f"{v}_sum_{s}"], out[f"{v}_avg_{s}"] = np.where(n > 0, t, np.nan), np.where(n > 0, t / n, np.nan)
        return pd.DataFrame(out)

    made = rows.unionByName(spine).groupBy("__block", "__tile").applyInPandas(dense, T.StructType(fields))
    real = [F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in fields[2:]]
    return made.select("entity", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day_number")).alias("day"), *real)
