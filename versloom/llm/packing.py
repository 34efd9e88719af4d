"""Problem 7: filling fixed-capacity containers with items.

Method: bin completion, a branch-and-bound search. The largest open item starts
a container; the undominated fillings around it are enumerated, fullest first,
from the sums that the open items can reach; waste bounds prune, and best-fit
solutions are the incumbents.

Items are packed in batches, each on its own, so the work is linear in the
items and any number of tasks share it. Batches are dealt from all items in
order of size, so that each has large and small ones in the same proportions.
A search fills its containers to the brim as long as it can and leaves the
unused room to the last ones; those are opened again and packed with those of
other batches, round by round, until one batch is left.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versloom.operators.positions import with_running_total
from versloom.session import staged
from versloom.tables import table

#: Items of a batch, and nodes of its search beyond the first descent; those of the last batch.
BATCH, NODES, LAST_NODES = 512, 400, 4000
#: Fillings of a container that are checked for dominance.
DOMINANCE = 100
#: Of this many of the fullest fillings, which leave at most so much more room than the first, the one that keeps small items back is tried first.
LOOK, NEAR = 12, 3
#: Containers of a batch that are opened again, bundles they are opened into, and batches whose open bundles are one batch of the next round.
REOPENED, BUNDLES, MERGED = 4, 12, 16


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Containers that no packing can do without: items above half, plus the rest by volume, for every threshold (Martello and Toth's L2)."""
    if not sizes:
        return 0
    s = np.sort(np.asarray(sizes))
    total, best = np.concatenate(([0], np.cumsum(s))), -(-int(s.sum()) // capacity)
    for t in np.unique(s[s <= capacity // 2]):
        big, half, low = np.searchsorted(s, capacity - t, "right"), np.searchsorted(s, capacity / 2, "right"), np.searchsorted(s, t, "left")
        n1, n2 = len(s) - big, big - half
        small = total[half] - total[low]
        free = n2 * capacity - (total[big] - total[half])
        best = max(best, n1 + n2 + max(0, -int(-(small - free) // capacity)))
    return best


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing."""
    rooms: list[tuple[int, int]] = []
    out: list[list[int]] = []
    for s in sorted(sizes, reverse=True):
        k = bisect_left(rooms, (s, -1))
        if k == len(rooms):
            out.append([s])
            insort(rooms, (capacity - s, len(out) - 1))
        else:
            room, b = rooms.pop(k)
            out[b].append(s)
            insort(rooms, (room - s, b))
    return out


def _dominated(filling: tuple[int, ...], others: list[int], slack: int) -> bool:
    """Whether an open item could stand in for one or two of ``filling`` and fill more, or simply fits beside it."""
    if others and others[0] <= slack:
        return True
    parts = [*filling, *(a + b for i, a in enumerate(filling) for b in filling[i + 1 :])]
    return any((k := bisect_right(others, p + slack)) and others[k - 1] > p for p in parts)


def fillings(open_: list[int], room: int, waste: int) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``room`` from the sorted ``open_`` that leave at most ``waste``, fullest first.

    The sums that the smallest items reach are kept as bits for every number of
    items, so no step of the enumeration leads nowhere. After ``DOMINANCE``
    checks dominated fillings come too: they are worse, not wrong.
    """
    a = open_[: bisect_right(open_, room)]
    mask, reach, checks = (1 << (room + 1)) - 1, [1], DOMINANCE
    for s in a:
        reach.append((reach[-1] | (reach[-1] << s)) & mask)
    for target in range(room, max(0, room - waste) - 1, -1):
        if not reach[-1] >> target & 1:
            continue
        stack: list[tuple[int, int, tuple[int, ...]]] = [(len(a), target, ())]
        while stack:
            i, left, chosen = stack.pop()
            # items without a size fill nothing and come last
            if not left and (not i or a[i - 1] or target):
                if target < room and checks:
                    checks -= 1
                    others = list(a)
                    for x in chosen:
                        others.pop(bisect_left(others, x))
                    if _dominated(chosen, others, room - target):
                        continue
                yield chosen
                continue
            if not i:
                continue
            if a[i - 1] > left:
                i = bisect_right(a, left, 0, i)
            s = a[i - 1]
            k = bisect_left(a, s, 0, i)
            if reach[k] >> left & 1:  # no more of this size
                stack.append((k, left, chosen))
            if s <= left and reach[i - 1] >> (left - s) & 1:
                stack.append((i - 1, left - s, (*chosen, s)))


def _ordered(fs: Iterator[tuple[int, ...]]) -> Iterator[tuple[int, ...]]:
    """``fs`` with those of the first that keep small items back before the others: small items fill what later containers leave."""
    head = list(islice(fs, LOOK))
    fullest = max(map(sum, head), default=0)
    head.sort(key=lambda f: (sum(f) < fullest - NEAR, -min(f, default=0), -sum(f)))
    return chain(head, fs)


def bin_completion(sizes: list[int], capacity: int, nodes: int = NODES, spare: int = 0) -> list[list[int]]:
    """``sizes``, none above ``capacity``, as containers; as few as the search finds, the fewest possible if it ends.

    Of packings with as few containers the one is taken in which the search
    filled container after container, so that the room left over is in the last
    ones. The search ends early when the lower bound is met. ``nodes`` bounds
    its steps beyond the first descent; then the best packing so far is taken.
    With ``spare`` so many containers more than best fit needs are allowed, for
    batches whose last containers are opened again.
    """
    empty, sizes = [s for s in sizes if s == 0], [s for s in sizes if s > 0]
    if not sizes:
        return [empty] if empty else []
    best = best_fit(sizes, capacity)
    most, bound, left_nodes = len(best) + spare, lower_bound(sizes, capacity), nodes + len(sizes)
    # each level: open items, their total, the containers made, and the fillings not tried yet
    levels: list[tuple[list[int], int, list[list[int]], Iterator[tuple[int, ...]]]] = []

    def descend(open_: list[int], total: int, made: list[list[int]]) -> None:
        room = capacity - open_[-1]
        # more waste than that in this container can't be made up for
        waste = (most - len(made)) * capacity - total
        levels.append((open_, total, made, _ordered(fillings(open_[:-1], room, min(room, waste))) if waste >= 0 else iter(())))

    descend(sorted(sizes), sum(sizes), [])
    while levels and left_nodes:
        open_, total, made, more = levels[-1]
        f = next(more, None)
        # the incumbent may have come down since the level was opened
        if f is None or len(made) + -(-total // capacity) > most:
            levels.pop()
            continue
        left_nodes -= 1
        after = open_[:-1]
        for x in f:
            after.pop(bisect_left(after, x))
        now = [*made, [open_[-1], *f]]
        if after:
            descend(after, total - open_[-1] - sum(f), now)
            continue
        best, most = now, len(now) - 1
        if len(best) <= bound:
            break
    best[-1].extend(empty)
    return best


def pack(df: DataFrame, item: str, size: str, capacity: int, batch: int = BATCH) -> DataFrame:
    """(container, item, piece, start, size): every item of ``df`` in containers of ``capacity``.

    An item above the capacity is cut: full containers of its own and a last
    piece that is packed like an item; no other item is cut. ``start`` is where
    the piece begins in the item. A null or negative size counts as 0; items of
    size 0 are packed too. Repeated rows and null items are items of their own.
    An empty table gives an empty table. ``container`` is unique over all
    batches. Other columns are not carried; join by the item.
    """
    if item in ("container", "piece", "start", "size"):
        raise ValueError(f"the item can't be named {item}: that is a column of the result")
    spark = df.sparkSession
    kind = df.schema[item].dataType
    sized = df.select(F.col(item).alias("_item"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("_size"), F.lit(1).alias("_one"))
    # the last key tells repeated rows apart; which of them comes first makes no difference
    order = [F.col("_size").desc(), F.xxhash64("_item"), F.col("_item").asc_nulls_first(), F.col("_id")]
    ranked = with_running_total(sized.withColumn("_id", F.monotonically_increasing_id()), order, "_one", "_rank")
    batches = max(1, -(-ranked.count() // batch))
    held = T.StructType().add("container", "long").add("_batch", "long").add("_bundle", "integer").add("_item", kind).add("piece", "integer").add("start", "long").add("size", "long")

    def containers(frame: pd.DataFrame, number: int, batch_no: int, last: bool) -> pd.DataFrame:
        """Bundles (rows of equal ``_bundle``) in containers; those opened again have the container null and new bundles."""
        at = [list(x) for x in frame.groupby("_bundle", sort=True).indices.values()]
        sums = frame["size"].to_numpy()
        by_size: dict[int, list[list[int]]] = {}
        for rows in at:
            by_size.setdefault(int(sums[rows].sum()), []).append(rows)
        made = bin_completion([s for s, xs in by_size.items() for _ in xs], capacity, LAST_NODES if last else NODES, 0 if last else 1)
        filled = [sum(c) for c in made]
        again = set() if last else {k for k in sorted(range(len(made)), key=lambda k: filled[k])[:REOPENED] if filled[k] < capacity}
        container, bundle = np.full(len(frame), -1, np.int64), np.zeros(len(frame), np.int32)
        fresh = 0
        for k, c in enumerate(made):
            for n, s in enumerate(sorted(c, reverse=True)):
                rows = by_size[s].pop()
                if k in again:
                    bundle[rows] = fresh + min(n, BUNDLES - 1)
                else:
                    container[rows] = (number << 60) + (batch_no << 24) + k
            fresh += BUNDLES if k in again else 0
        return frame.assign(container=pd.arrays.IntegerArray(container, container < 0), _batch=batch_no, _bundle=bundle)

    def first(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_rank", kind="stable").reset_index(drop=True)
        full, rest = np.divmod(frame["_size"].to_numpy(), capacity)
        exact = (rest == 0) & (full > 0)
        full, rest = np.where(exact, full - 1, full), np.where(exact, capacity, rest)
        own = pd.DataFrame({"_bundle": np.arange(len(frame)), "_item": frame["_item"], "piece": full, "start": full * capacity, "size": rest})
        out = containers(own, 0, int(key[0]), batches == 1)
        rows = np.repeat(np.arange(len(frame)), full)
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(full) - full, full)
        cut = pd.DataFrame({"_bundle": 0, "_item": frame["_item"].to_numpy()[rows], "piece": nth, "start": nth * capacity, "size": capacity})
        cut["container"], cut["_batch"] = (int(key[0]) << 24) + len(frame) + np.arange(len(rows)), int(key[0])
        return pd.concat([out, cut.astype({"container": "Int64"})])[held.names] if len(cut) else out[held.names]

    # a stated number of tasks: the rows are few bytes but the search is long, so partitions must not be merged by size
    slots = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = ranked.select("_item", "_size", "_rank", F.pmod("_rank", F.lit(batches)).alias("_batch"))
    made = staged(dealt.repartition(min(batches, slots), "_batch").groupBy("_batch").applyInPandas(first, held), "packed")
    out, number = made.where("container IS NOT NULL"), 0

    def repacked(number: int, last: bool):
        def again(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["_batch", "_bundle", "size", "piece"], kind="stable").reset_index(drop=True)
            frame["_bundle"] = frame["_batch"] % MERGED * REOPENED * BUNDLES + frame["_bundle"]
            return containers(frame, number, int(key[0]), last)[held.names]

        return again

    while batches > 1:
        number, batches = number + 1, -(-batches // MERGED)
        reopened = made.where("container IS NULL").withColumn("_to", F.expr(f"_batch div {MERGED}"))
        made = staged(reopened.repartition(min(batches, slots), "_to").groupBy("_to").applyInPandas(repacked(number, batches == 1), held), "packed")
        out = out.unionByName(made.where("container IS NOT NULL"))
    return out.select("container", F.col("_item").alias(item), "piece", "start", "size")


def byte_tokens(text: str = "text"):
    """Tokens of the ByT5 tokenizer: one for each UTF-8 byte and an end token; a null text has the end token only."""
    return F.coalesce(F.octet_length(text), F.lit(0)) + 1


def p7_containers(spark: SparkSession, folder: str, capacity: int = 4096) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", byte_tokens().alias("tokens"))
    return pack(docs, "doc_id", "tokens", capacity)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that the packing had to cut: their first piece is a full container with more to come."""
    cut = p7_containers(spark, folder).where("piece > 0")
    return cut.where("piece = 1").select("doc_id")


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, the least number that could hold the tokens, and the unused share."""
    c = p7_containers(spark, folder).groupBy("container").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("n"))
    least = F.ceil(F.sum("used") / 4096)
    return c.agg(F.count(F.lit(1)).alias("containers"), least.alias("least"), F.max("used").alias("fullest"), F.round(1 - F.sum("used") / (F.count(F.lit(1)) * 4096), 6).alias("unused"))


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What any right packing has in common: documents, tokens, documents cut, containers above the capacity, pieces that overlap or leave a gap."""
    from pyspark.sql import Window

    packed = staged(p7_containers(spark, folder), "containers")
    per = packed.groupBy("container").agg(F.sum("size").alias("used"))
    gap = F.col("start") != F.coalesce(F.lag(F.col("start") + F.col("size")).over(Window.partitionBy("doc_id").orderBy("piece")), F.lit(0))
    docs = packed.withColumn("gap", gap).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("tokens"), F.count_if("gap").alias("gaps"))
    whole = docs.agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"), F.count_if(F.col("pieces") > 1).alias("cut"), F.sum("gaps").alias("gaps"))
    return whole.crossJoin(per.agg(F.count_if(F.col("used") > 4096).alias("too_full")))  # one row each


QUERIES = {"p7_found": p7_found, "p7_containers": p7_containers, "p7_fill": p7_fill, "p7_checks": p7_checks}
_SIZES = "SELECT octet_length(encode(coalesce(text, ''))) + 1 AS n FROM documents"
ORACLE_SQL = {
    "p7_found": "SELECT doc_id FROM documents WHERE octet_length(encode(coalesce(text, ''))) + 1 > 4096",
    "p7_checks": f"SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS tokens, count(*) FILTER (n > 4096) AS cut, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS too_full FROM ({_SIZES})",
}
