"""Packing of items into containers of fixed capacity by vector best-fit.

Every container has three capacities: tokens, documents, and attention cost (the sum of squared
lengths, which is what attention within documents costs). Items go in descending size, each into the
open container where it fits under every constraint and where the score is best: ``norm`` leaves the
smallest weighted residual norm, ``dot`` takes the greatest weighted dot-product of demand and
residual; if none fits, a new container opens. An item larger than a container is cut into full
pieces and a rest, which is packed like any other item; no other item is cut.

An item is larger than a container if it exceeds its tokens, or, with ``cut_dense``, if its own square exceeds the
attention capacity; its pieces are then as long as lets a container be filled with them alone, and every container keeps every
constraint. Without ``cut_dense`` an item that fits by tokens stays whole; if it exceeds the attention capacity by itself, it has
its container to itself, and every container of two items or more keeps every constraint.

Items are spread over groups of about ``ITEMS_PER_GROUP`` by a hash of their key, and each group is
packed alone, so the work and memory of a task are bounded at any size; each group leaves at most a
few containers underfilled among about a thousand. Groups are spread over as many tasks by an explicit number of
partitions, which adaptive execution leaves as it is: the shuffle is small, the work on it is not.

Defined results: an item of no tokens takes no container (container null, piece 0); a null size counts as 0;
items repeated under a key are packed each time; ties are broken by key, so reruns agree; null keys are
packed like others.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
MAX_ITEMS = 256
#: Attention capacity as a share of the squared token capacity, which no sum of squares can exceed: below 1 it binds.
ATTENTION_SHARE = 0.75
MOST_TASKS = 10_000
ITEMS_PER_GROUP = 8192
WEIGHTS = (1.0, 0.05, 0.05)


def attention_capacity(capacity: int, max_attention: int | None = None) -> int:
    return int(capacity * capacity * ATTENTION_SHARE) if max_attention is None else max_attention


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY, max_items: int = MAX_ITEMS, max_attention: int | None = None, weights: tuple[float, float, float] = WEIGHTS, score: str = "norm", alone: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Container number and offset of each item; sizes descend and none exceeds a container.

    With ``alone`` an item may exceed the attention capacity, and then shares its container with no other.
    """
    limit = np.array([capacity, max_items, attention_capacity(capacity, max_attention)], float)
    n = len(sizes)
    if n and (sizes[0] > capacity or max_items < 1 or (not alone and int(sizes[0]) ** 2 > limit[2])):
        raise ValueError(f"an item of {int(sizes[0])} exceeds a container")
    container, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return container, offset
    left = np.empty((3, n))
    number = np.empty(n, np.int64)
    w = np.array(weights)[:, None] / limit[:, None] ** 2
    smallest = int(sizes[-1])
    open_count = made = 0
    for i, size in enumerate(sizes.tolist()):
        need = np.array([[size], [1.0], [float(size) * size]])
        live = left[:, :open_count]
        fits = np.flatnonzero((live >= need).all(axis=0))
        if len(fits):
            room = live[:, fits]
            value = -(w * (room - need) ** 2).sum(axis=0) if score == "norm" else (w * room * need).sum(axis=0)
            k = int(fits[np.argmax(value)])
        else:
            k = open_count
            left[:, k], number[k] = limit, made
            open_count, made = open_count + 1, made + 1
        container[i], offset[i] = number[k], capacity - left[0, k]
        left[:, k] -= need[:, 0]
        if left[0, k] < smallest or left[1, k] < 1 or left[2, k] < smallest * smallest:
            # nothing fits here any more; the last open container takes its place
            open_count -= 1
            left[:, k], number[k] = left[:, open_count], number[open_count]
    return container, offset


def pack(df: DataFrame, key: str, size: str, capacity: int = CAPACITY, max_items: int = MAX_ITEMS, max_attention: int | None = None, score: str = "norm", weights: tuple[float, float, float] = WEIGHTS, items: int | None = None, cut_dense: bool = True) -> DataFrame:
    """(key, piece, begin, n_tokens, container, start): where every part of every item goes.

    ``items`` is the number of rows, if the caller knows it more cheaply than by counting ``df``; it only sets the number
    of groups.

    ``begin`` is where the piece starts in its item, ``start`` where it lies in its container. Only key and
    size are shuffled, once.
    """
    kind = df.schema[key].dataType.simpleString()
    attention = attention_capacity(capacity, max_attention)
    longest = min(capacity, math.isqrt(attention)) if cut_dense else capacity
    # so many equal pieces fill a container without exceeding its attention capacity
    step = capacity // -(-capacity * capacity // attention) if cut_dense else capacity
    if longest < 1 or step < 1:
        raise ValueError("a container must hold one token at least")
    groups = max(1, -(-(df.count() if items is None else items) // ITEMS_PER_GROUP))
    sized = df.select(F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("_group"), F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size"))

    def one(table: pa.Table) -> pa.Table:
        size = table.column("size").to_numpy()
        order = table.append_column("minus", pa.array(-size))
        order = np.asarray(pc.sort_indices(order, sort_keys=[("minus", "ascending"), ("key", "ascending")]))
        size = size[order]
        group = int(table.column("_group")[0].as_py())
        full, rest = np.where(size > longest, size // step, 0), np.where(size > longest, size % step, size)
        exact = (rest == 0) & (full > 0)
        full, rest = full - exact, np.where(exact, step, rest)
        # pieces: `full` of the greatest length, then the rest
        pieces = full + 1
        owner = np.repeat(np.arange(len(size)), pieces)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        amount = np.where(piece < full[owner], step, rest[owner])
        sequence = np.argsort(-amount, kind="stable")
        placed = sequence[amount[sequence] > 0]
        number, offset = best_fit(amount[placed], capacity, max_items, attention, weights, score, alone=not cut_dense)
        container, start = np.full(len(owner), -1, np.int64), np.zeros(len(owner), np.int64)
        container[placed], start[placed] = number + (group << 32), offset
        keys = table.column("key").combine_chunks().take(pa.array(order[owner]))
        return pa.table(
            {"key": keys, "piece": pa.array(piece, pa.int32()), "begin": pa.array(piece * step), "n_tokens": pa.array(amount), "container": pa.array(container, mask=container < 0), "start": pa.array(start, pa.int32())}
        )

    packed = sized.repartition(min(groups, MOST_TASKS), "_group").groupBy("_group").applyInArrow(one, f"key {kind}, piece int, begin bigint, n_tokens bigint, container bigint, start int")
    return packed.withColumnRenamed("key", key)


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container, items, tokens, attention, unused) per container."""
    used = packed.where(F.col("container").isNotNull())
    return used.groupBy("container").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("attention")).withColumn("unused", F.lit(capacity) - F.col("tokens"))


def fill(packed: DataFrame, key: str, capacity: int = CAPACITY, max_items: int = MAX_ITEMS, max_attention: int | None = None) -> DataFrame:
    """One row on how well items were packed, every figure recomputed from the placements.

    items and tokens as they came in; pieces placed; split items, and those among them that fit by tokens (``split_whole``); containers;
    least, the fewest containers that any packing could do with by tokens, documents or attention; unused tokens;
    breaches: containers beyond a capacity (attention: of two items or more), and pieces that overlap or leave a gap in
    their container or their item; alone: containers of one item beyond the attention capacity.
    """
    attention = attention_capacity(capacity, max_attention)
    piece = F.struct("piece", "begin", "n_tokens")
    per_item = packed.groupBy(key).agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), F.array_sort(F.collect_list(piece)).alias("_p"))
    # pieces of an item follow one another; items repeated under a key cannot be told apart and are not judged
    repeated = F.size(F.filter("_p", lambda x: x["piece"] == 0)) > 1
    ended = F.aggregate("_p", F.lit(0).cast("bigint"), lambda at, x: F.when(at == x["begin"], at + x["n_tokens"]).otherwise(F.lit(-1).cast("bigint")))
    items = per_item.agg(
        F.count("*").alias("items"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"),
        F.count_if((F.col("pieces") > 1) & ~repeated).alias("split"),
        F.count_if((F.col("pieces") > 1) & ~repeated & (F.col("tokens") <= capacity)).alias("split_whole"),
        F.count_if(~repeated & (ended != F.col("tokens"))).alias("_torn"),
    )
    used = packed.where(F.col("container").isNotNull())
    lying = F.array_sort(F.collect_list(F.struct(F.col("start").cast("bigint").alias("s"), F.col("n_tokens").alias("n"))))
    per = used.groupBy("container").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"), F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("a"), lying.alias("_l"))
    tight = F.aggregate("_l", F.lit(0).cast("bigint"), lambda at, x: F.when(at == x["s"], at + x["n"]).otherwise(F.lit(-1).cast("bigint"))) == F.col("t")
    bad = (F.col("t") > capacity) | (F.col("n") > max_items) | ((F.col("a") > attention) & (F.col("n") > 1)) | ~tight
    zero = F.lit(0).cast("bigint")
    boxes = per.agg(F.count("*").alias("containers"), F.coalesce(F.sum("n"), zero).alias("_n"), F.coalesce(F.sum("t"), zero).alias("_t"), F.coalesce(F.sum(F.least("a", F.lit(attention))), zero).alias("_a"), F.count_if(bad).alias("_bad"), F.count_if((F.col("a") > attention) & (F.col("n") == 1)).alias("alone"))
    least = F.greatest(*[F.ceil(F.col(c) / F.lit(float(k))) for c, k in (("_t", capacity), ("_n", max_items), ("_a", attention))])
    return items.join(boxes).select("items", "tokens", "pieces", "split", "split_whole", "containers", least.alias("least"), (F.col("containers") * capacity - F.col("_t")).alias("unused"), (F.col("_bad") + F.col("_torn")).alias("breaches"), "alone")
