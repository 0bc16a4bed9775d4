"""Hierarchies from parent-child links: root, depth, path and descendants of every node, loops marked.

A weighted disjoint-set forest is built bottom-up. The links are range-partitioned by id, so that
most parents lie in their child's partition; each partition unites its links by path compression
and gives each node its topmost local ancestor with the number of steps to it. Only the tops whose
parent lies elsewhere go on to the next level, as links of their own that carry those steps as
weight, until one task of bounded size holds what is left. Where that does not shrink the links
(parents at random places), the same compression goes on across partitions by self-joins, each of
which doubles the distance looked ahead, so no task ever holds more than ``task_rows`` links.

Paths are walked inside the partitions through an index of parents; the fronts of those whose top
has its parent elsewhere double the same way, so their rounds grow with the logarithm of the depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.session import cut, task_slots

#: Links one task unites in memory (about 100 bytes each).
TASK_ROWS = 200_000
#: Path elements of one batch that a walk gives out.
WALK_ROWS = 2_000_000
#: A level has to drop at least this share of its links, else the rest is compressed by joins (figures in the README).
LEAST_SHRINK = 0.3
#: What a node on a loop, or below one, gets as root and depth.
LOOP = -1

LOCAL = "id long, top long, steps long, up long, up_weight long, loop boolean"


def unite(ids: np.ndarray, parents: np.ndarray, has: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each link of one partition: position of its topmost ancestor here, steps to it, and whether it meets a loop.

    ``ids`` ascend and are distinct. Each round compresses every pointer to its pointer's pointer.
    """
    n = len(ids)
    at = np.searchsorted(ids, parents)
    at[at == n] = 0
    inside = has & (ids[at] == parents) if n else has
    top = np.where(inside, at, np.arange(n))
    steps = np.where(inside, weights, 0).astype(np.int64)
    for _ in range(int(n).bit_length() + 1):
        further = top[top]
        moved = further != top
        if not moved.any():
            break
        steps = np.where(moved, steps + steps[top], steps)
        top = further
    # Only a loop has, after more than log2(n) rounds, a top with a parent of its own here.
    return top, steps, inside[top]


def _unite_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frames = [b for b in batches if len(b)]
    if not frames:
        return
    links = pd.concat(frames, ignore_index=True).sort_values("id", kind="stable")
    ids = links["id"].to_numpy(np.int64)
    has = links["parent"].notna().to_numpy()
    parents = links["parent"].fillna(0).to_numpy(np.int64)
    weights = links["weight"].to_numpy(np.int64)
    top, steps, loop = unite(ids, parents, has, weights)
    up = pd.Series(parents[top]).where(has[top] & ~loop).astype("Int64")
    size = 200_000
    for i in range(0, len(ids), size):
        s = slice(i, i + size)
        yield pd.DataFrame({"id": ids[s], "top": ids[top[s]], "steps": steps[s], "up": up[s], "up_weight": weights[top[s]], "loop": loop[s]})


def _level(links: DataFrame, parts: int) -> DataFrame:
    placed = links.coalesce(1) if parts == 1 else links.repartitionByRange(parts, "id")
    return placed.mapInPandas(_unite_partition, LOCAL)


def _double(links: DataFrame, count: int) -> DataFrame:
    """(id, root, depth, loop) of links too scattered for a level: pointers joined to their pointers until none moves."""
    state = links.select("id", F.col("parent").alias("root"), F.col("weight").alias("depth"))
    for _ in range(count.bit_length() + 1):
        nxt = state.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        state = cut(
            state.join(nxt, "root", "left").select(
                "id",
                F.coalesce("next", "root").alias("root"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                F.col("next").isNotNull().alias("moved"),
            )
        )
        if not state.where("moved").limit(1).count():
            break
    return state.select("id", "root", "depth", F.col("moved").alias("loop"))


def _solve(links: DataFrame, task_rows: int) -> DataFrame:
    """(id, root, depth, loop) of links (id, parent, weight), where parents that are no id are the roots."""
    count = links.count()
    if count <= task_rows:
        local = _level(links, 1)
        return local.select(
            "id",
            F.coalesce("up", "top").alias("root"),
            (F.col("steps") + F.when(F.col("up").isNotNull(), F.col("up_weight")).otherwise(0)).alias("depth"),
            "loop",
        )
    local = cut(_level(links, -(-count // task_rows) + 1))
    rest = cut(_upward(local))
    if rest.count() > (1 - LEAST_SHRINK) * count:
        return _double(links, count)
    return _compose(local, _solve(rest, task_rows))


def _upward(local: DataFrame) -> DataFrame:
    """The links that leave their partition: each open top with the top its parent has, both steps as weight."""
    tops = local.where((F.col("id") == F.col("top")) & F.col("up").isNotNull()).select(F.col("id").alias("child"), "up", "up_weight")
    seen = local.select(F.col("id").alias("up"), F.col("top").alias("up_top"), "steps", F.col("loop").alias("up_loop"))
    return tops.join(seen, "up", "left").select(
        F.col("child").alias("id"),
        # Below a loop of another partition: a link to itself is a loop again.
        F.when(F.col("up_loop"), F.col("child")).otherwise(F.coalesce("up_top", "up")).alias("parent"),
        (F.col("up_weight") + F.coalesce("steps", F.lit(0))).alias("weight"),
    )


def _compose(local: DataFrame, above: DataFrame) -> DataFrame:
    higher = above.select(F.col("id").alias("top"), "root", "depth", F.col("loop").alias("above_loop"))
    return local.join(higher, "top", "left").select(
        "id",
        F.coalesce("root", "top").alias("root"),
        (F.col("steps") + F.coalesce("depth", F.lit(0))).alias("depth"),
        (F.col("loop") | F.coalesce("above_loop", F.lit(False))).alias("loop"),
    )


def clean_links(rows: DataFrame, node: str, parent: str, place: str | None = None) -> DataFrame:
    """One row (id, parent, place) for each non-null id; of several parents or places of one id the smallest counts."""
    where = F.min(F.col(place).cast("long")) if place else F.lit(None).cast("long")
    return rows.where(F.col(node).isNotNull()).groupBy(F.col(node).cast("long").alias("id")).agg(F.min(F.col(parent).cast("long")).alias("parent"), where.alias("place"))


def resolve_forest(rows: DataFrame, node: str, parent: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Root and depth of every node.

    Gives id, parent (as stated), root, depth (long). A parent that is no node does not count: its
    child is a root. Nodes on a loop or below one have root and depth -1. Rows with a null id are
    dropped, repeated rows count once, of several parents of an id the smallest counts; an empty
    table gives an empty result; other columns of ``rows`` are not read.
    """
    return _forest(cut(clean_links(rows, node, parent)), task_rows).drop("place")


def _parts(count: int, task_rows: int, slots: int) -> int:
    return max(slots, -(-count // task_rows))


def _forest(nodes: DataFrame, task_rows: int) -> DataFrame:
    count = nodes.count()
    links = nodes.select("id", "parent", F.lit(1).cast("long").alias("weight"))
    local = cut(_level(links, _parts(count, task_rows, task_slots(nodes.sparkSession))))
    tops = local.where((F.col("id") == F.col("top")) & F.col("up").isNotNull()).select("id", "up", "up_weight")
    # Links to parents that exist; the other tops are roots.
    known = local.select(F.col("id").alias("up"), F.col("top").alias("parent"), "steps", F.col("loop").alias("up_loop"))
    rest = cut(
        tops.join(known, "up").select(
            "id",
            F.when(F.col("up_loop"), F.col("id")).otherwise(F.col("parent")).alias("parent"),
            (F.col("up_weight") + F.col("steps")).alias("weight"),
        )
    )
    return _marked(_compose(local, _solve(rest, task_rows)), nodes)


def _marked(forest: DataFrame, nodes: DataFrame) -> DataFrame:
    return forest.join(nodes, "id").select(
        "id",
        "parent",
        F.when(F.col("loop"), F.lit(LOOP)).otherwise(F.col("root")).cast("long").alias("root"),
        F.when(F.col("loop"), F.lit(LOOP)).otherwise(F.col("depth")).cast("long").alias("depth"),
        "place",
    )


WALKED = "id long, stated long, top long, up long, ids array<long>, places array<long>"


def _walk_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Local paths by an index of parents: from the highest ancestor in the partition down to each node.

    Given out in batches of a bounded number of path elements; all that is kept is the index.
    """
    table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if table is None:
        return
    table = table.sort_by("id")
    ids = table["id"].to_numpy()
    parent = table["up"].combine_chunks()
    has = parent.is_valid().to_numpy(zero_copy_only=False)
    parents = parent.fill_null(0).to_numpy()
    places = table["place"].combine_chunks()
    at = np.searchsorted(ids, parents)
    at[at == len(ids)] = 0
    inside = has & (ids[at] == parents)
    above = np.where(inside, at, -1)
    top, steps, _ = unite(ids, parents, has, np.ones(len(ids), np.int64))
    size = steps + 1
    total = np.cumsum(size)
    first = 0
    while first < len(ids):
        end = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + WALK_ROWS, side="right")))
        stop = np.cumsum(size[first:end])
        chain = np.empty(int(stop[-1]), np.int64)
        node, last, left = np.arange(first, end), stop - 1, size[first:end]
        while len(node):
            chain[last] = node
            more = left > 1
            node, last, left = above[node[more]], last[more] - 1, left[more] - 1
        offsets = pa.array(np.concatenate([[0], stop]).astype(np.int32))
        s = slice(first, end)
        high = top[s]
        up = pa.array(parents[high], mask=~has[high])
        yield pa.record_batch(
            [pa.array(ids[s]), table["stated"].combine_chunks()[s], pa.array(ids[high]), up, pa.ListArray.from_arrays(offsets, pa.array(ids[chain])), pa.ListArray.from_arrays(offsets, places.take(pa.array(chain)))],
            names=["id", "stated", "top", "up", "ids", "places"],
        )
        first = end


def tree_paths(rows: DataFrame, node: str, parent: str, task_rows: int = TASK_ROWS, place: str | None = None) -> DataFrame:
    """Full path (ids from the root down to the node) beside root and depth, for every node that meets no loop.

    Gives id, parent, root, depth, path (array of long), places (array of the ``place`` of the same
    nodes, null where none is named or stated); nodes with root -1 have null arrays. Cases as in
    ``resolve_forest``. The rounds over what crosses partitions are as many as the logarithm of the
    crossings, whatever the depth; no task keeps more than the links of its partition.
    """
    nodes = cut(clean_links(rows, node, parent, place))
    forest = cut(_forest(nodes, task_rows))
    sound = forest.where(F.col("root") != LOOP).select("id", F.col("parent").alias("stated"), F.when(F.col("depth") > 0, F.col("parent")).alias("up"), "place")
    parts = _parts(nodes.count(), task_rows, task_slots(rows.sparkSession))
    local = cut(sound.repartitionByRange(parts, "id").mapInArrow(_walk_partition, WALKED))
    waiting = local.where(F.col("up").isNotNull())
    above = local.select(F.col("id").alias("up"), F.col("top").alias("next"), F.col("ids").alias("front"), F.col("places").alias("front_places"))
    fronts = cut(waiting.where(F.col("id") == F.col("top")).select("top", "up").join(above, "up").select("top", "next", "front", "front_places"))
    while True:
        further = fronts.select(F.col("top").alias("next"), F.col("next").alias("__next"), F.col("front").alias("__front"), F.col("front_places").alias("__places"))
        open_ = fronts.where(F.col("next").isNotNull()).join(further, "next", "left")
        longer = open_.select(
            "top",
            F.col("__next").alias("next"),
            F.when(F.col("__front").isNotNull(), F.concat("__front", "front")).otherwise(F.col("front")).alias("front"),
            F.when(F.col("__front").isNotNull(), F.concat("__places", "front_places")).otherwise(F.col("front_places")).alias("front_places"),
        )
        if not fronts.where(F.col("next").isNotNull()).limit(1).count():
            break
        fronts = cut(fronts.where(F.col("next").isNull()).unionByName(longer))
    columns = ["id", "stated", F.col("ids").alias("path"), "places"]
    crossing = waiting.join(fronts.select("top", "front", "front_places"), "top").select("id", "stated", F.concat("front", "ids").alias("path"), F.concat("front_places", "places").alias("places"))
    every = local.where(F.col("up").isNull()).select(*columns).unionByName(crossing)
    out = every.select("id", F.col("stated").alias("parent"), F.element_at("path", 1).alias("root"), (F.size("path") - 1).cast("long").alias("depth"), "path", "places")
    looped = forest.where(F.col("root") == LOOP).select("id", "parent", "root", "depth", F.lit(None).cast("array<long>").alias("path"), F.lit(None).cast("array<long>").alias("places"))
    return out.unionByName(looped)


def dotted(places: str = "places") -> F.Column:
    """The places of the steps below the root, each after a dot; ? where a step has none."""
    return F.array_join(F.transform(F.slice(places, F.lit(2), F.size(places)), lambda x: F.concat(F.lit("."), F.coalesce(x.cast("string"), F.lit("?")))), "")


def descendants(paths: DataFrame) -> DataFrame:
    """(ancestor_id, id, distance, place) for every node below another, from ``tree_paths``; as many rows as the depths sum to.

    ``place`` is the dotted places of the steps from the ancestor down.
    """
    above = F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("k", "ancestor_id")
    below = paths.where(F.size("path") > 1).select("id", "depth", "places", above)
    return below.select("ancestor_id", "id", (F.col("depth") - F.col("k")).cast("long").alias("distance"), F.slice("places", F.col("k") + 1, F.size("places")).alias("places")).withColumn("place", dotted()).drop("places")


def loops(forest: DataFrame) -> DataFrame:
    """(id, loop_id) of the nodes that lie on a loop itself, from ``resolve_forest``; ``loop_id`` is the smallest id of that loop.

    The links of all nodes with root -1 are followed for at least as many steps as there are such
    nodes, in doubled strides: after that every node stands on a loop, and all of every loop is stood on.
    """
    bad = cut(forest.where(F.col("root") == LOOP).select("id", F.col("parent").alias("next"), F.least("id", "parent").alias("least")))
    count = bad.count()
    for _ in range(count.bit_length()):
        ahead = bad.select(F.col("id").alias("next"), F.col("next").alias("__next"), F.col("least").alias("__least"))
        bad = cut(bad.join(ahead, "next").select("id", F.col("__next").alias("next"), F.least("least", "__least").alias("least")))
    return bad.join(bad.select(F.col("next").alias("id")).distinct(), "id", "left_semi").select("id", F.col("least").alias("loop_id"))
