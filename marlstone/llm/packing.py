"""Items of varying size into containers with several limits at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.tokens import n_tokens
from marlstone.session import durable

#: Items packed together in one task, and the fill below which a container's items are packed once more.
SHARD_ITEMS = 4096
REPACK_BELOW = 0.97
#: Powers of an item's length that its product is divided by, see ``dot_product_pack``.
POWERS = (0.0, 0.8)


def dot_product_pack(sizes: np.ndarray, limits: np.ndarray, powers: tuple[float, ...] = POWERS) -> np.ndarray:
    """Container number of each item (rows of ``sizes``); every item must fit an empty container, or has one for itself.

    Containers are filled one by one: of the items that still fit, the one goes in whose vector has
    the largest dot product with the container's remaining room, both relative to the limits and
    weighted by the demand for each dimension. The product is divided by a power of the item's own
    length: with 0 large items come first, towards 1 the direction decides, so that a container with
    many places left takes small items. Which serves better depends on the limit that binds, so each
    of ``powers`` is tried and the fewest containers win. Ties go to the earlier item and power.
    """
    best: np.ndarray | None = None
    for power in powers:
        bins = _pack_once(sizes / limits, power)
        if best is None or len(bins) and bins.max() < best.max():
            best = bins
    return best


def _pack_once(share: np.ndarray, power: float) -> np.ndarray:
    n, dims = share.shape
    demand = share.sum(axis=0)
    weight = demand / demand.max() if n and demand.max() > 0 else np.ones(dims)
    order = np.lexsort((np.arange(n), -(share @ weight)))
    bins = np.full(n, -1, dtype=np.int64)
    even = [j for j in range(dims) if n and share[:, j].min() == share[:, j].max()]
    free = [j for j in range(dims) if j not in even]
    columns = [np.ascontiguousarray(share[order, j]) for j in free]
    length = np.sqrt((share[order] ** 2).sum(axis=1)) ** power if power else None
    # A dimension of which all items take the same bounds their number; its part of the product is the same for all.
    most = min([n, *[int((1 + 1e-9) / share[0, j]) for j in even if share[0, j] > 0]]) if n else 0
    places = np.arange(n)
    k = 0
    while len(places):
        taken = [0]  # an empty container weighs all dimensions alike, and that is the order
        room = [1 - c[0] for c in columns]
        at, open_ = np.arange(1, len(places)), [c[1:] for c in columns]
        long = length[1:] if power else None
        while len(at) and len(taken) < most:
            if open_:
                fits = open_[0] <= room[0] + 1e-12
                for c, r in zip(open_[1:], room[1:]):
                    fits &= c <= r + 1e-12
                at, open_ = at[fits], [c[fits] for c in open_]
                long = long[fits] if power else None
                if not len(at):
                    break
            product = sum(c * (weight[j] * r) for j, c, r in zip(free, open_, room)) + sum(weight[j] * share[0, j] * (1 - len(taken) * share[0, j]) for j in even)
            best = int((product / long if power else product).argmax()) if open_ else 0
            taken.append(int(at[best]))
            room = [r - c[best] for c, r in zip(open_, room)]
            if open_:
                open_[0][best] = np.inf  # no longer fits
            else:
                at = at[1:]
        bins[order[places[taken]]] = k
        places, columns = np.delete(places, taken), [np.delete(c, taken) for c in columns]
        length = np.delete(length, taken) if power else None
        k += 1
    return bins


def items_of(df: DataFrame, key: str, text: str, capacities: DataFrame, tokenizer: str | None = None, max_loss: float = 1.0, keep_whole: bool = False) -> DataFrame:
    """Sized items per capacity: ``capacity_id``, ``capacity``, ``key``, ``piece``, ``tokens``, ``loss``.

    A text's first paragraph, if more follows, is its prompt and bears no loss; without one all
    tokens do. A text that exceeds the capacity in tokens or ``max_loss`` x capacity in loss-bearing
    ones is cut into pieces of the smaller of the two and a rest; every other text is one item.
    ``keep_whole`` cuts only texts that exceed the capacity, and keeps the rest whole whatever loss they bear. NULL
    and empty texts take no room and give no item; capacities that are NULL or not positive hold nothing.
    """
    head = F.regexp_extract(F.col(text), r"^([^\n]+\n\s*\n)", 1)
    sized = df.select(F.col(key).alias("key"), n_tokens(F.col(text), tokenizer).alias("__n"), n_tokens(F.when(F.length(head) < F.length(text), head), tokenizer).alias("__p"))
    sized = durable(sized.filter("__n > 0").withColumn("__u", F.monotonically_increasing_id()))
    caps = capacities.filter("capacity_tokens > 0").groupBy("capacity_id").agg(F.min("capacity_tokens").alias("capacity"))
    both = sized.select("*", F.explode(caps_array(caps)).alias("__c")).select("*", F.col("__c.capacity_id"), F.col("__c.capacity"))
    loss_limit = F.greatest(F.lit(1), F.floor(F.col("capacity") * max_loss)).cast("int")
    over = F.col("__n") > F.col("capacity")
    if not keep_whole:
        over = over | (F.col("__n") - F.least("__p", "__n") > loss_limit)
    both = both.withColumn("__size", F.when(over, F.least("capacity", loss_limit)).otherwise(F.col("__n")))
    pieces = both.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / F.col("__size")).cast("int"))).alias("piece"))
    start = F.col("piece") * F.col("__size")
    tokens = F.least(F.col("__size"), F.col("__n") - start)
    loss = tokens - F.greatest(F.lit(0), F.least(tokens, F.col("__p") - start))
    return pieces.select("capacity_id", "capacity", "key", "__u", "piece", tokens.alias("tokens"), loss.alias("loss"))


def caps_array(caps: DataFrame) -> Column:
    """The capacities as a literal array; they are settings and bounded as such, a row each."""
    kinds = dict(caps.dtypes)
    made = [F.struct(F.lit(r["capacity_id"]).cast(kinds["capacity_id"]).alias("capacity_id"), F.lit(r["capacity"]).cast("int").alias("capacity")) for r in caps.orderBy("capacity_id").collect()]
    return F.array(*made).cast(f"array<struct<capacity_id:{kinds['capacity_id']},capacity:int>>")


def _pack_round(items: DataFrame, shard: Column, limits: dict[str, Column], first: int) -> DataFrame:
    """Pack each (capacity, shard) group; container numbers are unique through shard and round."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__u", "piece"], kind="stable")
        sizes = np.column_stack([pdf["tokens"], np.ones(len(pdf)), pdf["loss"]]).astype(float)
        bins = dot_product_pack(sizes, pdf[["capacity", "__segments", "__loss"]].iloc[0].to_numpy(dtype=float))
        pdf["bin"] = ((int(pdf["__shard"].iloc[0]) * 2 + first) << 32) + bins
        return pdf[["capacity_id", "capacity", "key", "__u", "piece", "tokens", "loss", "bin"]]

    d = items.withColumns({"__shard": shard, **limits})
    kinds = dict(items.dtypes)
    schema = f"capacity_id {kinds['capacity_id']}, capacity int, key {kinds['key']}, __u bigint, piece int, tokens int, loss int, bin bigint"
    return d.groupBy("capacity_id", "__shard").applyInPandas(pack, schema)


def pack_documents(df: DataFrame, capacities: DataFrame, key: str = "doc_id", text: str = "text", max_segments: int | Column | None = None, max_loss: float = 1.0, tokenizer: str | None = None, keep_whole: bool = False) -> DataFrame:
    """Texts into containers of each capacity: ``capacity_id``, ``bin``, ``key``, ``piece``, ``tokens``, ``loss``.

    A container holds at most the capacity in tokens, ``max_segments`` items (a number or an expression
    of ``capacity``; default: one per 16 tokens of it) and ``max_loss`` x capacity loss-bearing tokens (1, the default, never binds). No text is split unless it alone exceeds a limit (see ``items_of``);
    with ``keep_whole`` only if it exceeds the capacity, and one that exceeds the loss limit alone has a container for itself.

    Items are spread at random over shards of about SHARD_ITEMS and packed there by
    ``dot_product_pack``; a shard's last, poorly filled containers are then emptied and their items
    packed once more together. No group depends on a key of the data, so none can be hot.
    """
    if not 0 < max_loss <= 1:
        raise ValueError("max_loss is a share of the capacity")
    items = durable(items_of(df, key, text, capacities, tokenizer, max_loss, keep_whole))
    segments = F.floor(F.col("capacity") / 16) if max_segments is None else max_segments if isinstance(max_segments, Column) else F.lit(max_segments)
    limits = {"__segments": F.greatest(F.lit(1), segments), "__loss": F.greatest(F.lit(1), F.floor(F.col("capacity") * max_loss))}
    shards = lambda n: max(1, -(-n // SHARD_ITEMS))
    per_capacity = max([r["count"] for r in items.groupBy("capacity_id").count().collect()] or [0])
    spread = lambda n: F.pmod(F.xxhash64("__u", "piece"), F.lit(n)).cast("int")
    once = durable(_pack_round(items, spread(shards(per_capacity)), limits, 0))
    filled = once.groupBy("capacity_id", F.col("bin").alias("__b")).agg((F.sum("tokens") / F.first("capacity") < REPACK_BELOW).alias("__poor"), F.first("capacity_id").alias("__c")).drop("capacity_id")
    marked = durable(once.join(filled, (once["bin"] == F.col("__b")) & (once["capacity_id"] == F.col("__c"))).drop("__b", "__c"))
    poor = marked.filter("__poor").drop("bin", "__poor")
    again = _pack_round(poor, spread(shards(poor.count())), limits, 1)
    names = ["capacity_id", "bin", F.col("key").alias(key), "piece", "tokens", "loss"]
    return marked.filter("not __poor").select(*names).unionByName(again.select(*names))
