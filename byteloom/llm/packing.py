"""Best-fit packing of token sequences (operator 5) by the configuration linear program over the histogram of lengths.

1. A pass over the texts gives pieces (at most `capacity` tokens) with lengths and checksums; it is written to the shared folder.
2. The histogram of lengths (at most `capacity` rows, whatever the input's size) goes to the driver. The program "cover every length with as few full sequences as can be" is
   solved there by multiplicative weights: each round prices configurations by a knapsack dynamic program over weights that grow for lengths that lag behind, and gives each
   configuration found a fraction of what remains, until a fixed small share of the pieces is left. The weights, scaled by the knapsack's optimum, are feasible for the dual
   program, so each round also gives a lower bound on the sequences needed (`bound`, with the bounds by area and by long pieces).
3. The fractions are rounded down. What they leave goes, the longest first, by best fit into the room of the sequences kept and into new ones, or into new ones with the least
   slack. Rounding is tried at several thresholds, below which a configuration isn't kept at all; the highest keeps none, so the result never takes more sequences than best
   fit decreasing of all pieces.
4. Each piece's rank among those of its length selects its place. Ranks are counted within salted groups and shifted by the groups' totals, so no
   length, however frequent, meets in one task.

A null text counts as empty: it has just the end token. Repeated rows are packed once each; among fully equal rows places are exchangeable.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from byteloom.llm import bpe
from byteloom.llm.common import stored

CAPACITY, END_ID = 2048, 0
_FAR = 1 << 40
Config = tuple[tuple[tuple[int, int], ...], int]


def _price(value: np.ndarray, capacity: int) -> tuple[list[int], list[int]]:
    """Unbounded knapsack: the length to take last for the best filling of each size, and the size that is filled as well and last gained."""
    best, take, same = np.zeros(capacity + 1), [0] * (capacity + 1), [0] * (capacity + 1)
    for w in range(1, capacity + 1):
        x = best[w - 1 :: -1][:w] + value[1 : w + 1]
        k = int(x.argmax())
        if x[k] > best[w - 1]:
            best[w], take[w], same[w] = x[k], k + 1, w
        else:
            best[w], same[w] = best[w - 1], same[w - 1]
    return take, same


def _filling(priced: tuple[list[int], list[int]], room: int) -> list[int]:
    (take, same), found = priced, []
    while room := same[room]:
        found.append(take[room])
        room -= take[room]
    return found


def bound(histogram: dict[int, int], capacity: int = CAPACITY, weights: np.ndarray | None = None) -> int:
    """Sequences that any packing takes at least: by area, by pieces too long to share with others, and by weights of lengths, as a dual solution of the program."""
    n = np.zeros(capacity + 1)
    for length, k in histogram.items():
        n[length] = k
    sizes = np.arange(capacity + 1)
    found = [n @ sizes / capacity]
    if weights is not None:
        best = np.zeros(capacity + 1)
        for w in range(1, capacity + 1):
            best[w] = max(best[w - 1], (best[w - 1 :: -1][:w] + weights[1 : w + 1]).max())
        if best[capacity] > 0:
            found.append(n @ weights / best[capacity])
    counts, areas = np.cumsum(n), np.cumsum(n * sizes)
    half = capacity // 2
    for least in range(1, half + 1):  # pieces over capacity - least take one each; of those down to `least`, what the others over half leave must hold the area
        alone = counts[capacity] - counts[capacity - least]
        large = counts[capacity - least] - counts[half]
        room = large * capacity - (areas[capacity - least] - areas[half])
        found.append(alone + large + max(0.0, (areas[half] - areas[least - 1] - room) / capacity))
    return int(np.ceil(max(found) - 1e-6))


def program(wanted: np.ndarray, capacity: int = CAPACITY, share: float = 0.4, pull: float = 0.5, left_over: float = 0.02, rounds: int = 24) -> tuple[dict, np.ndarray]:
    """A fractional solution: configuration ((length, how many), ...) to sequences, and the last weights. At most left_over of the pieces aren't in it."""
    left, sizes = wanted.astype(np.float64), np.arange(capacity + 1)
    weight, found = np.ones(capacity + 1), {}
    for _ in range(rounds):
        if left.sum() <= left_over * wanted.sum():
            break
        value = np.where(left > 0, sizes * weight, -1.0)
        priced, before = _price(value, capacity), left.copy()
        turn = left * share  # no length is used up ahead of the others
        for length in np.flatnonzero(before)[::-1].tolist():
            if turn[length] <= 0:
                continue
            counts = {length: 1}
            for x in _filling(priced, capacity - length):
                if turn[x] > 0:
                    counts[x] = counts.get(x, 0) + 1
            times = min(turn[x] / a for x, a in counts.items())
            for x, a in counts.items():
                left[x] = max(0.0, left[x] - a * times)
                turn[x] -= a * times
            config = tuple(sorted(counts.items(), reverse=True))
            found[config] = found.get(config, 0.0) + times
        some = before > 0
        served = (before - left) / np.maximum(before, 1e-9)
        weight[some] *= np.exp(pull * (served[some].mean() - served[some]))  # lengths that lag behind gain weight
        weight /= weight[some].max()
    return found, sizes * weight


def _best_fit(left: np.ndarray, kept: list[Config], capacity: int) -> list[Config]:
    """Pieces, the longest first, each into the fullest sequence that has room; sequences of one filling are treated together, so the work doesn't grow with their number."""
    by_room: dict[int, list[tuple[Counter, int]]] = {}
    rooms: list[int] = []

    def add(filling, room, times):
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append((filling, times))

    for config, times in kept:
        add(Counter(dict(config)), capacity - sum(x * a for x, a in config), times)
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                filling, times = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            else:
                room, filling, times = capacity, Counter(), n
            each = room // length
            full = min(times, n // each)
            if full:
                add(filling + Counter({length: each}), room - each * length, full)
                n -= full * each
                times -= full
            if n and times and n < each:
                add(filling + Counter({length: n}), room - n * length, 1)
                n, times = 0, times - 1
            if times and (filling or room < capacity):
                add(filling, room, times)
    merged: dict = {}
    for room in rooms:
        for filling, times in by_room[room]:
            config = tuple(sorted(filling.items(), reverse=True))
            merged[config] = merged.get(config, 0) + times
    return list(merged.items())


def _least_slack(left: np.ndarray, capacity: int) -> list[Config]:
    """Sequences that begin with the longest piece left and are filled as far as any choice of the others can, the longer first. Each filling is repeated until it uses up
    one of its lengths, so there are no more fillings than lengths, however many pieces."""
    left, plan = left.copy(), []
    for longest in np.flatnonzero(left)[::-1].tolist():
        while left[longest]:
            room = capacity - longest
            have = left.copy()
            have[longest] -= 1
            items, reach = [], [1]
            mask = (1 << room + 1) - 1
            for x in np.flatnonzero(have[: room + 1])[::-1].tolist():
                n, part = min(int(have[x]), room // x), 1
                while n:  # 1, 2, 4, ... of them, and the rest
                    part = min(part, n)
                    items.append((x, part))
                    reach.append((reach[-1] | reach[-1] << x * part) & mask)
                    n, part = n - part, 2 * part
                if reach[-1] >> room & 1:
                    break
            target, counts = reach[-1].bit_length() - 1, Counter({longest: 1})
            for (x, part), before in zip(items[::-1], reach[-2::-1]):
                if not before >> target & 1:
                    counts[x] += part
                    target -= x * part
            times = min(int(left[x]) // a for x, a in counts.items())
            for x, a in counts.items():
                left[x] -= a * times
            plan.append((tuple(sorted(counts.items(), reverse=True)), times))
    return plan


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Config]:
    """Configurations ((length, how many), ...) with how many sequences have each; together they hold exactly the histogram."""
    wanted = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a length of {length} doesn't fit")
        wanted[length] = n
    fractions, _ = program(wanted, capacity)
    best, fewest, least = [], math.inf, bound(histogram, capacity)
    for threshold in (1, 2, 8, math.inf):
        kept = [(c, int(x)) for c, x in fractions.items() if x >= threshold]
        left = wanted.copy()
        for config, times in kept:
            for x, a in config:
                left[x] -= a * times
        for fit in (_best_fit, lambda left, kept, capacity: kept + _least_slack(left, capacity)):
            plan = fit(left, kept, capacity)
            taken = sum(t for _, t in plan)
            if taken < fewest:
                best, fewest = plan, taken
            if fewest <= least:  # none takes fewer
                return best
    return best


def _intervals(plan: list[Config]) -> dict[str, np.ndarray]:
    """Of each length, which ranks go to which run of sequences: sorted by length and first rank."""
    rows, used, sequence = [], {}, 0
    for config, times in plan:
        offset = 0
        for length, a in config:
            low = used.get(length, 0)
            rows.append((length * _FAR + low, low, a, sequence, offset))
            used[length] = low + a * times
            offset += a * length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("key", "low", "a", "sequence", "offset"), table.T.copy()))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """key, piece, start, length, ids_crc32: each document's ids and the end id, cut only where longer than the capacity."""
    kind = docs.schema[key].dataType.simpleString()
    end = np.asarray([END_ID], "<u4").tobytes()

    def run(batches):
        model = bpe.model(path)
        for b in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, data in enumerate(model.encode_all(x.as_py() for x in b.column(1))):
                data += end
                for k, s in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[s : s + 4 * capacity]
                    at.append(i)
                    piece.append(k)
                    start.append(s // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=[key, "piece", "start", "length", "ids_crc32"])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def place(cut: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", per_group: int = 50_000) -> DataFrame:
    """Adds sequence_id and offset to rows of pieces, which should be a stored table: it is read twice."""
    spark = cut.sparkSession
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = spark.sparkContext.broadcast(_intervals(solve(histogram, capacity)))
    groups = max(16, -(-sum(histogram.values()) // per_group))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    totals = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("length", "salt").orderBy(key, "piece")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(shift, ["length", "salt"]).select(key, "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("shift")).alias("rank"))
    kind = cut.schema[key].dataType.simpleString()

    def run(batches):
        t = table.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(t["key"], length * _FAR + rank, side="right") - 1
            over = rank - t["low"][i]
            sequence, offset = t["sequence"][i] + over // t["a"][i], t["offset"][i] + over % t["a"][i] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece."""
    return place(stored(pieces(docs, path, capacity), "pieces"), capacity)
