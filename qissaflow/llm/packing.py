"""Documents in containers of a fixed number of tokens (problem 6), by linear grouping.

A size is a whole number up to the container's room, and only the count of each size comes to the driver: as many rows as a
container has tokens at most, whatever the input. There

1. items over ``room / SMALL`` are put into ``GROUPS`` groups of equal count by falling size, and each counts as large as its group's largest;
2. for these few sizes the fractional covering problem over configurations (how many of each size a container holds) is
   solved by column generation, and the whole part of the solution is taken;
3. actual sizes take the places of their group, the largest first, so that containers have room again;
4. what is left of the large ones and then the small ones are put, by falling size, where they fit best.

Everything is done on counts: equal containers are one row. Documents then find their container by their rank among those of their
size, which is counted within ``SALT``-ed parts of a size, so that a hot size is no single task.

Defined results: null and empty texts are left out; only a text over ``room`` is split, into full containers and one rest that
shares a container; documents delivered again are packed again; columns other than the id and the text are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qissaflow.llm.scratch import written

CONTAINER, GROUPS, SMALL, SALT = 4096, 16, 8, 64


def grouped(counts: dict[int, int], groups: int = GROUPS) -> list[list[tuple[int, int]]]:
    """(size, count) by falling size in groups of equal count; a size may lie in two of them."""
    total = sum(counts.values())
    out: list[list[tuple[int, int]]] = []
    left = 0
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            if not left:
                left = -(-total // groups)
                out.append([])
            take = min(n, left)
            out[-1].append((size, take))
            n, left = n - take, left - take
    return out


def _best_configuration(sizes: list[int], worth: np.ndarray, room: int) -> np.ndarray:
    """How many of each size a container should hold to be worth most (unbounded knapsack)."""
    best = np.zeros(room + 1)
    choice = np.full(room + 1, -1)
    for c in range(min(sizes), room + 1):
        gains = [(best[c - s] + w, k) for k, (s, w) in enumerate(zip(sizes, worth)) if s <= c]
        top, k = max(gains)
        if top > best[c - 1] + 1e-12:
            best[c], choice[c] = top, k
        else:
            best[c] = best[c - 1]
    out, c = np.zeros(len(sizes)), room
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            out[choice[c]] += 1
            c -= sizes[choice[c]]
    return out


def configurations(sizes: list[int], demand: list[int], room: int, rounds: int = 200) -> list[tuple[int, np.ndarray]]:
    """Whole parts of the best fractional covering: how often each configuration is used."""
    n = len(sizes)
    columns = [np.where(np.arange(n) == k, room // s, 0).astype(float) for k, s in enumerate(sizes)]
    basis = list(range(n))
    for _ in range(rounds):
        matrix = np.column_stack([columns[b] for b in basis])
        inverse = np.linalg.inv(matrix)
        used, worth = inverse @ np.array(demand, float), np.maximum(np.ones(n) @ inverse, 0)
        new = _best_configuration(sizes, worth, room)
        if new @ worth <= 1 + 1e-9:
            break
        along = inverse @ new
        ratios = np.where(along > 1e-9, used / np.where(along > 1e-9, along, 1), np.inf)
        columns.append(new)
        basis[int(ratios.argmin())] = len(columns) - 1
    used = np.linalg.solve(np.column_stack([columns[b] for b in basis]), np.array(demand, float))
    return [(int(x + 1e-9), columns[b].astype(int)) for x, b in zip(used, basis) if x + 1e-9 >= 1]


def _substituted(groups: list[list[tuple[int, int]]], plan: list[tuple[int, np.ndarray]]) -> tuple[list[tuple[int, Counter]], Counter]:
    """Equal containers of actual sizes with their number, and what found no place."""
    queues = [deque(g) for g in groups]

    def take(k: int, n: int) -> list[tuple[int, int]]:
        """(size, count) of the next ``n`` items of group k; fewer if it has fewer."""
        out = []
        while n and queues[k]:
            size, m = queues[k].popleft()
            if m > n:
                queues[k].appendleft((size, m - n))
            out.append((size, min(m, n)))
            n -= min(m, n)
        return out

    out = []
    for times, own in plan:
        slots = [take(k, times) for k, n in enumerate(own) for _ in range(n)]
        at = 0
        edges = sorted({e for s in slots for e in np.cumsum([n for _, n in s]).tolist()})
        for edge in edges:
            held: Counter = Counter()
            for slot in slots:
                seen = 0
                for size, n in slot:
                    seen += n
                    if seen > at:
                        held[size] += 1
                        break
            if held:
                out.append((edge - at, held))
            at = edge
    rest: Counter = Counter()
    for q in queues:
        for size, n in q:
            rest[size] += n
    return out, rest


def _best_fit(bins: list[tuple[int, Counter]], counts: Counter, room: int) -> list[tuple[int, Counter]]:
    """Items by falling size, each into the fullest container that has room for it."""
    by_gap: dict[int, list[tuple[int, Counter]]] = {}
    gaps: list[int] = []

    def put(times: int, held: Counter, gap: int) -> None:
        if times:
            if gap not in by_gap:
                by_gap[gap] = []
                insort(gaps, gap)
            by_gap[gap].append((times, held))

    for times, held in bins:
        put(times, held, room - sum(s * n for s, n in held.items()))
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(gaps, size)
            if at < len(gaps):
                gap = gaps[at]
                times, held = by_gap[gap].pop()
                if not by_gap[gap]:
                    del by_gap[gap], gaps[at]
            else:
                gap, times, held = room, -(-n // (room // size)), Counter()
            each = min(n, gap // size)
            full = min(times, n // each)
            put(full, held + Counter({size: each}), gap - each * size)
            if held:
                put(times - full, held, gap)
            n -= full * each
            if not held and n and full < times:  # a new container that isn't filled
                put(1, Counter({size: n}), gap - n * size)
                n = 0
    return [x for own in by_gap.values() for x in own]


def patterns(counts: dict[int, int], room: int = CONTAINER) -> list[tuple[int, Counter]]:
    """(number of containers, size to how often it stands in each of them); every item is placed once."""
    large = {s: n for s, n in counts.items() if s > room // SMALL}
    small = Counter({s: n for s, n in counts.items() if s <= room // SMALL})
    groups = grouped(large)
    sizes, demand = [g[0][0] for g in groups], [sum(n for _, n in g) for g in groups]
    bins, rest = _substituted(groups, configurations(sizes, demand, room) if groups else [])
    return _best_fit(_best_fit(bins, rest, room), small, room)


def too_large(df: DataFrame, id_column: str, text_column: str, room: int = CONTAINER) -> DataFrame:
    """The documents that the filling had to split."""
    return containers(df, id_column, text_column, room).where("piece = 1").select(id_column)


def ranked(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``rank`` among the rows of a size, from 0, counted in two steps."""
    salted = parts.withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(SALT)))
    sizes = salted.groupBy("size", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("size", "salt").orderBy(*keys)).cast("long") - 1
    return salted.withColumn("own", inside).join(sizes.select("size", "salt", before.alias("before")), ["size", "salt"]).withColumn("rank", F.col("before") + F.col("own"))


def containers(df: DataFrame, id_column: str, text_column: str, room: int = CONTAINER) -> DataFrame:
    """container, id, piece and fill (the container's tokens) of all non-empty texts."""
    size = (F.octet_length(text_column) + 1).cast("long")
    sized = df.where(f"{text_column} <> ''").select(F.col(id_column).alias("id"), size.alias("tokens"))
    full = F.floor((F.col("tokens") - 1) / room).cast("int")
    parts = sized.select("id", "tokens", full.alias("full")).select("id", F.explode(F.sequence(F.lit(0), F.col("full"))).alias("piece"), "full", "tokens")
    parts = written(parts.select("id", "piece", F.when(F.col("piece") < F.col("full"), room).otherwise(F.col("tokens") - F.col("full") * room).cast("int").alias("size")), "parts")
    counts = {r["size"]: r["n"] for r in parts.groupBy("size").agg(F.count("*").alias("n")).collect()}
    slots, first, seen = [], 0, dict.fromkeys(counts, 0)
    for times, own in patterns(counts, room):
        fill = sum(s * n for s, n in own.items())
        for s, n in own.items():
            slots.append((s, seen[s], n, first, fill))
            seen[s] += n * times
        first += times
    # size and first rank as one number: the last slot at or below a row's number is its own
    table = np.array(sorted((s << 44 | low, low, each, begin, fill) for s, low, each, begin, fill in slots), np.int64).reshape(-1, 5)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, rank = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy()
            own = table[np.searchsorted(table[:, 0], sizes << 44 | rank, "right") - 1]
            where = own[:, 3] + (rank - own[:, 1]) // own[:, 2]
            yield pa.RecordBatch.from_arrays([pa.array(where), batch.column(0), batch.column(1), pa.array(own[:, 4].astype(np.int32))], ["container", "id", "piece", "fill"])

    placed = ranked(parts, ["id", "piece"]).select("id", "piece", "size", "rank")
    kind = parts.schema["id"].dataType.simpleString()
    return placed.mapInArrow(place, f"container bigint, id {kind}, piece int, fill int").withColumnRenamed("id", id_column)
