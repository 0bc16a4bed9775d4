"""Filling containers of fixed capacity with whole texts, by bin completion.

Sizes are tokens of a public tokenizer. A text larger than the capacity is cut into full containers
and a rest; the rests and all other texts are dealt at random into groups of a bounded number of
containers, and each group is packed by itself: best fit decreasing gives the first incumbent, then
branch and bound completes one container after the other around its largest text with undominated
fillings of least waste, as long as the waste so far leaves room for a better packing.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.session import cut

#: Rank file of the tokenizer (a parameter), and the fixed pattern that splits text before its merges.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Containers in a group; at most one of them is left part empty for want of texts.
GROUP_CONTAINERS = 1_500
#: Most capacities at once (they are collected), branch-and-bound nodes a group beyond one per container,
#: steps of one enumeration of fillings, and fillings tried per container.
CAPACITIES, NODES, STEPS, FILLINGS = 1_000, 2_000, 150, 4


def token_counts(docs: DataFrame, key: str, text: str, ranks: str = RANKS) -> DataFrame:
    """(key, tokens) of every row; null and empty texts have 0 tokens."""
    with open(ranks, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.value.splitlines())}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64())], names=["key", "tokens"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(count, f"key {kind}, tokens long")


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that any packing needs: the sum bound, and for each threshold the texts that cannot share one."""
    if not len(sizes):
        return 0
    ascending = np.sort(sizes)
    total = np.concatenate([[0], np.cumsum(ascending)])
    half = np.searchsorted(ascending, capacity // 2, side="right")
    alpha = np.unique(np.concatenate([[0], ascending[:half]]))
    big = np.searchsorted(ascending, capacity - alpha, side="right")
    big = np.maximum(big, half)
    small = np.searchsorted(ascending, alpha, side="left")
    middle = big - half
    room = middle * capacity - (total[big] - total[half])
    rest = np.maximum(0, total[half] - total[np.minimum(small, half)] - room)
    return int(max((len(sizes) - big + middle + -(-rest // capacity)).max(), -(-int(total[-1]) // capacity)))


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Packs sizes (descending) each into the fullest container that still takes it; gives positions by container."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i, size in enumerate(sizes):
        at = bisect_left(room, (size, -1))
        if at == len(room):
            bins.append([i])
            left, number = capacity - size, len(bins) - 1
        else:
            left, number = room.pop(at)
            bins[number].append(i)
            left -= size
        if left:
            insort(room, (left, number))
    return bins


def _dominates(a: list[int], b: list[int]) -> bool:
    """Whether the sizes of ``b`` fit into the places of the sizes of ``a`` (both descending), first fit."""
    room = list(a)
    for x in b:
        for i, r in enumerate(room):
            if r >= x:
                room[i] -= x
                break
        else:
            return False
    return True


def fillings(room: int, values: list[int], counts: list[int], first: int) -> list[tuple[int, list[int]]]:
    """Up to FILLINGS undominated ways (waste, positions in ``values``) to fill ``room``, least waste first.

    ``values`` descend; ``counts`` says how many of each are left; positions start at ``first``.
    A filling is maximal: nothing that is left fits into its waste.
    """
    n = len(values)
    least = n - 1
    while least >= first and not counts[least]:
        least -= 1
    if least < first or values[least] > room:
        return [(room, [])]
    negative = [-v for v in values]
    found: list[tuple[int, list[int]]] = []
    used: dict[int, int] = {}
    chosen: list[int] = []
    steps = 0

    def search(room: int, start: int) -> bool:
        nonlocal steps
        i = max(start, bisect_left(negative, -room))
        deeper = False
        while i <= least:
            steps += 1
            if steps > STEPS:
                return True
            if counts[i] > used.get(i, 0):
                deeper = True
                chosen.append(i)
                used[i] = used.get(i, 0) + 1
                done = search(room - values[i], i)
                used[i] -= 1
                chosen.pop()
                if done:
                    return True
            i += 1
        if not deeper:
            # Maximal unless something before ``start`` would still fit.
            j = max(first, bisect_left(negative, -room))
            if all(counts[k] <= used.get(k, 0) for k in range(j, min(start, least + 1))):
                found.append((room, list(chosen)))
                return room == 0 or len(found) >= 8 * FILLINGS
        return False

    search(room, first)
    if not found:
        greedy, left, i = [], room, max(first, bisect_left(negative, -room))
        while i <= least:
            take = min(counts[i], left // values[i])
            greedy += [i] * take
            left -= take * values[i]
            i = max(i + 1, bisect_left(negative, -left))
        found.append((left, greedy))
    found.sort(key=lambda f: f[0])
    kept: list[tuple[int, list[int]]] = []
    for waste, filling in found:
        sizes = [values[i] for i in filling]
        if not any(len(k) <= 6 and len(sizes) <= 6 and _dominates([values[i] for i in k], sizes) for _, k in kept):
            kept.append((waste, filling))
        if len(kept) == FILLINGS:
            break
    return kept


def complete(values: list[int], counts: list[int], capacity: int, target: int, nodes: int) -> list[list[int]] | None:
    """A packing into at most ``target`` containers as positions in ``values``, or None if none was found in ``nodes`` nodes."""
    slack = target * capacity - sum(v * c for v, c in zip(values, counts))
    if slack < 0:
        return None
    counts = list(counts)
    left = sum(counts)
    #: Per level: the largest text's position, the fillings still to try, the one taken, its waste.
    stack: list[list] = []
    waste, first, descend = 0, 0, True
    while True:
        if descend:
            if not left:
                return [[s[0], *s[2]] for s in stack]
            nodes -= 1
            if nodes < 0:
                return None
            first = stack[-1][0] if stack else 0
            while not counts[first]:
                first += 1
            counts[first] -= 1
            left -= 1
            stack.append([first, fillings(capacity - values[first], values, counts, first), None, 0])
        top = stack[-1]
        if top[2] is not None:
            for i in top[2]:
                counts[i] += 1
            left += len(top[2])
            waste -= top[3]
            top[2] = None
        # The last container may stay part empty: then nothing is left and its waste is within the slack anyway.
        if top[1] and waste + top[1][0][0] <= slack:
            top[3], top[2] = top[1].pop(0)
            for i in top[2]:
                counts[i] -= 1
            left -= len(top[2])
            waste += top[3]
            descend = True
        else:
            counts[top[0]] += 1
            left += 1
            stack.pop()
            if not stack:
                return None
            descend = False


def pack(sizes: list[int], capacity: int, nodes: int = NODES) -> list[list[int]]:
    """Packs sizes from 1 to ``capacity``; gives the positions in ``sizes`` of each container."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    descending = [sizes[i] for i in order]
    best = best_fit_decreasing(descending, capacity)
    bound = lower_bound(np.array(sizes, np.int64), capacity)
    values = sorted(set(descending), reverse=True)
    at = {v: i for i, v in enumerate(values)}
    counts = [0] * len(values)
    for s in descending:
        counts[at[s]] += 1
    target = bound
    while target < len(best):
        better = complete(values, counts, capacity, target, target + nodes)
        if better is None:
            # Not reached: halfway between the bound and the incumbent is tried next.
            target += max(1, (len(best) - target) // 2)
            continue
        places: list[list[int]] = [[] for _ in values]
        for position, size in enumerate(descending):
            places[at[size]].append(position)
        best = [[places[i].pop() for i in filling] for filling in better]
        break
    return [[order[i] for i in b] for b in best]


PACKED = "size_id long, group int, container long, key {kind}, piece int, tokens long"


def fill_containers(docs: DataFrame, capacities: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS, group_containers: int = GROUP_CONTAINERS) -> DataFrame:
    """Every text's containers, for each capacity.

    ``capacities``: size_id, capacity_tokens (at most CAPACITIES distinct rows; null or less than 1
    is left out). Gives size_id, container_id, the key, piece (0 for a whole text), first_token and
    tokens. A text is cut only if it alone exceeds the capacity, into full containers and a rest.
    Null and empty texts take no room: they get a null container. Repeated rows are texts of their
    own; columns that ``docs`` or ``capacities`` have besides are not read; no texts give no rows.
    """
    spark: SparkSession = docs.sparkSession
    sizes = capacities.where("capacity_tokens >= 1").select("size_id", "capacity_tokens").distinct().orderBy("size_id").limit(CAPACITIES + 1).collect()
    if len(sizes) > CAPACITIES:
        raise ValueError(f"more than {CAPACITIES} capacities")
    # Written once, so a row keeps its number in every later use.
    counted = cut(token_counts(docs, key, text, ranks).withColumn("row", F.monotonically_increasing_id()))
    kind = dict(counted.dtypes)["key"]
    result = "size_id long, container_id string, piece int, first_token long, tokens long"
    if not sizes:
        return spark.createDataFrame([], f"{key} {kind}, {result}")
    per_size = F.explode(F.array(*[F.struct(F.lit(int(i)).cast("long").alias("size_id"), F.lit(int(c)).cast("long").alias("capacity")) for i, c in sizes])).alias("size")
    texts = counted.select("key", "row", "tokens", per_size).select("key", "row", "tokens", "size.*")
    held = texts.where("tokens > 0")
    pieces = held.select(
        "key", "row", "size_id", "capacity", F.posexplode(F.transform(F.sequence(F.lit(0), ((F.col("tokens") - 1) / F.col("capacity")).cast("int")), lambda i: F.least(F.col("capacity"), F.col("tokens") - i * F.col("capacity")))).alias("piece", "size")
    )
    full = pieces.where("size = capacity")
    loose = pieces.where("size < capacity")
    # Groups by what the loose pieces of a capacity hold together; a row for each capacity comes to the driver.
    held_tokens = dict(loose.groupBy("size_id").agg(F.sum("size")).collect())
    groups = {int(i): int(held_tokens.get(i) or 0) // (int(c) * group_containers) + 1 for i, c in sizes}
    count = F.element_at(F.create_map(*[F.lit(x) for kv in groups.items() for x in kv]), F.col("size_id").cast("int"))
    dealt = loose.withColumn("group", F.pmod(F.xxhash64("row", "piece", "size_id"), count).cast("int"))

    def pack_group(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "key", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins = pack(frame["size"].tolist(), int(frame["capacity"].iloc[0]))
        container = np.empty(len(frame), np.int64)
        for number, positions in enumerate(bins):
            container[positions] = number
        return pd.DataFrame({"size_id": frame["size_id"], "group": frame["group"], "container": container, "key": frame["key"], "piece": frame["piece"], "tokens": frame["size"]})

    packed = dealt.groupBy("size_id", "group").applyInPandas(pack_group, PACKED.format(kind=kind))
    name = F.concat_ws("-", "size_id", "group", "container")
    out = packed.join(F.broadcast(spark.createDataFrame([(int(i), int(c)) for i, c in sizes], "size_id long, capacity long")), "size_id")
    out = out.select("size_id", name.alias("container_id"), "key", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), "tokens")
    alone = full.select("size_id", F.concat_ws("-", "size_id", F.lit("full"), "row", "piece").alias("container_id"), "key", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), F.col("size").alias("tokens"))
    empty = texts.where("tokens = 0").select("size_id", F.lit(None).cast("string").alias("container_id"), "key", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first_token"), "tokens")
    return out.unionByName(alone).unionByName(empty).withColumnRenamed("key", key)


def fill_report(filled: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens, unused tokens and their share."""
    used = filled.where("container_id IS NOT NULL").groupBy("size_id").agg(F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    sized = used.join(capacities.select("size_id", "capacity_tokens").distinct(), "size_id")
    unused = F.col("containers") * F.col("capacity_tokens") - F.col("tokens")
    return sized.select("size_id", "containers", "tokens", unused.alias("unused_tokens"), F.round(unused / (F.col("containers") * F.col("capacity_tokens")), 6).alias("unused_share"))
