"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token pieces of at most `capacity`; only longer ones are cut, the remainder first. Full pieces
fill a sequence each. The others are dealt by a hash of their row into shards of bounded size. Each shard is
evolved on several islands, every (shard, island) a group of its own that holds only lengths and bins; after each
epoch of a few generations an island's elite migrates to the next island of the ring. Crossover injects well-filled
bins whole, drops the bins that hold their documents a second time, swaps displaced documents for smaller ones of the
bins where that fills them better, and best-fits the rest, largest first. A shard stops early when a generation has
reached the volume bound. Documents of the worst-filled bins of all shards are dealt anew in a last, smaller round.

Null text is empty (the end id alone); repeated rows are documents of their own; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship
from .tokens import encoder

CAPACITY, SHARD_ITEMS, ISLANDS, EPOCHS = 1024, 2048, 2, 3
POPULATION, GENERATIONS, WELL_FILLED = 5, 6, 0.98


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""
    ship(docs.sparkSession)
    end = np.array([end_id], dtype=np.uint32)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_to_ids = encoder(vocabulary)
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                c, out = b.slice(k, 1000), []
                for doc, ids in zip(c.column(0).to_pylist(), texts_to_ids(c.column(1).to_pylist())):
                    ids = np.concatenate([ids, end])
                    first = len(ids) % capacity or capacity
                    edges = [0, *range(first, len(ids) + 1, capacity)]
                    out += [(doc, i, s, e - s, zlib.crc32(memoryview(ids[s:e]))) for i, (s, e) in enumerate(zip(edges, edges[1:]))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


Bins = list[list[int]]


def best_fit(items: list[int], size: list[int], bins: Bins, room: list[int], capacity: int) -> None:
    """Put items, in their order, each into the fullest bin that has room, else into a new one.

    The set of rooms that occur is one integer's bits, so the best bin is its lowest bit at or above the size.
    """
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(room):
        if r:
            by_room.setdefault(r, []).append(b)
            mask |= 1 << r
    for i in items:
        s = size[i]
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            open_bins = by_room[r]
            b = open_bins.pop()
            if not open_bins:
                mask &= ~(1 << r)
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
            room.append(capacity)
        left = r - s
        room[b] = left
        if left:
            by_room.setdefault(left, []).append(b)
            mask |= 1 << left


def fill_by_pairs(size: list[int], capacity: int, tries: int = 40) -> Bins:
    """Each bin opens with the largest document left and takes what fills it best: one document, or two at once.

    The sizes left are one integer's bits, so the largest that fits is the highest bit below the room.
    """
    by_size: dict[int, list[int]] = {}
    for i in sorted(range(len(size)), key=lambda i: -i):
        by_size.setdefault(size[i], []).append(i)
    left = sum(1 << s for s in by_size)
    bins: Bins = []

    def take(s: int) -> int:
        nonlocal left
        i = by_size[s].pop()
        if not by_size[s]:
            left &= ~(1 << s)
        return i

    while left:
        s = left.bit_length() - 1
        own, room = [take(s)], capacity - s
        while room and (fits := left & ((2 << room) - 1)):
            best = [fits.bit_length() - 1]
            for _ in range(tries):
                if not fits or sum(best) == room:
                    break
                a = fits.bit_length() - 1
                fits ^= 1 << a
                rest = left & ((2 << (room - a)) - 1)
                if len(by_size[a]) < 2:
                    rest &= ~(1 << a)
                if rest and a + rest.bit_length() - 1 > sum(best):
                    best = [a, rest.bit_length() - 1]
            own += [take(x) for x in best]
            room -= sum(best)
        bins.append(own)
    return bins


def fitness(bins: Bins, size: list[int]) -> tuple[int, int]:
    """Fewer bins first, then the larger sum of squared fills."""
    return len(bins), -sum(sum(size[i] for i in b) ** 2 for b in bins)


def lower_bound(size: list[int], capacity: int) -> int:
    """Volume bound, with items of over half a bin alone or beside what fits (Martello and Toth's L2)."""
    s = np.sort(np.array(size, np.int64))
    sums = np.concatenate([[0], np.cumsum(s)])
    half = np.searchsorted(s, capacity // 2, side="right")
    t = np.unique(np.append(capacity - s[half:], 0))
    top = np.searchsorted(s, capacity - t, side="right")  # beyond are those that no item of t or more fits beside
    middle = np.maximum(top - half, 0)
    small = sums[half] - sums[np.minimum(np.searchsorted(s, t), half)]
    beside = middle * capacity - (sums[np.maximum(top, half)] - sums[half])
    needed = len(s) - np.maximum(top, half) + middle + np.maximum(0, -(-(small - beside) // capacity))
    return int(max(-(-sums[-1] // capacity), needed.max()))


def swap_in(loose: list[int], size: list[int], bins: Bins, room: list[int]) -> list[int]:
    """Swap one document of a bin for the loose one that fills the bin best; what is loose then, smaller on the whole."""
    by_size: dict[int, list[int]] = {}
    for i in loose:
        by_size.setdefault(size[i], []).append(i)
    mask = sum(1 << s for s in by_size)
    for k, r in enumerate(room):
        if not r:
            continue
        gain, place, within = 0, -1, (1 << r) - 1
        for at, i in enumerate(bins[k]):
            fits = mask >> (size[i] + 1) & within
            if fits.bit_length() > gain:
                gain, place = fits.bit_length(), at
        if gain:
            old = bins[k][place]
            s = size[old] + gain
            bins[k][place] = by_size[s].pop()
            if not by_size[s]:
                del by_size[s]
                mask &= ~(1 << s)
            by_size.setdefault(size[old], []).append(old)
            mask |= 1 << size[old]
            room[k] = r - gain
    return [i for own in by_size.values() for i in own]


def settle(loose: list[int], size: list[int], bins: Bins, room: list[int], capacity: int) -> None:
    loose = swap_in(loose, size, bins, room)
    best_fit(sorted(loose, key=lambda i: (-size[i], i)), size, bins, room, capacity)


def crossover(a: Bins, b: Bins, size: list[int], capacity: int, draw: random.Random) -> Bins:
    fill = [sum(size[i] for i in x) for x in a]
    ranked = sorted(range(len(a)), key=lambda k: -fill[k])
    inject = [k for k in ranked[: max(1, len(a) // 2)] if fill[k] == capacity or draw.random() < 0.7]
    held = {i for k in inject for i in a[k]}
    bins, room, displaced = [list(a[k]) for k in inject], [capacity - fill[k] for k in inject], []
    for x in b:
        if held.isdisjoint(x):
            bins.append(list(x))
            room.append(capacity - sum(size[i] for i in x))
        else:
            displaced += [i for i in x if i not in held]
    settle(displaced, size, bins, room, capacity)
    return bins


def mutate(bins: Bins, size: list[int], capacity: int, draw: random.Random, n: int = 6) -> Bins:
    """Break the emptiest bins and a few others, place their documents again."""
    fill = [sum(size[i] for i in b) for b in bins]
    ranked = sorted(range(len(bins)), key=fill.__getitem__)
    gone = {*ranked[:n], *draw.sample(range(len(bins)), min(n, len(bins)))}
    kept = [k for k in range(len(bins)) if k not in gone]
    out, room = [list(bins[k]) for k in kept], [capacity - fill[k] for k in kept]
    settle([i for k in gone for i in bins[k]], size, out, room, capacity)
    return out


def evolve(size: list[int], seeds: list[Bins], seed: int, capacity: int = CAPACITY, population: int = POPULATION, generations: int = GENERATIONS) -> Bins:
    """The best packing that an island finds from its seeds and fresh individuals."""
    draw, bound = random.Random(seed), lower_bound(size, capacity)
    order = sorted(range(len(size)), key=lambda i: (-size[i], i))
    herd = list(seeds)
    if not seeds:
        herd.append(fill_by_pairs(size, capacity))
        while len(herd) < population:
            bins: Bins = []
            noisy = order if len(herd) == 1 else sorted(order, key=lambda i: -size[i] * draw.uniform(0.9, 1.0))
            best_fit(noisy, size, bins, [], capacity)
            herd.append(bins)
    ranked = sorted(((fitness(x, size), k, x) for k, x in enumerate(herd)), key=lambda x: x[:2])
    for g in range(generations):
        a, b = draw.sample(ranked, 2) if len(ranked) > 1 else ranked * 2
        fresh = [crossover(a[2], b[2], size, capacity, draw), mutate(ranked[0][2], size, capacity, draw)]
        ranked = sorted([*ranked, *((fitness(x, size), population + 2 * g + k, x) for k, x in enumerate(fresh))], key=lambda x: x[:2])[:population]
        if ranked[0][0][0] <= bound:
            break
    return ranked[0][2]


_ITEM = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ITEMS = [x.split()[0] for x in _ITEM.split(", ")]
_STATE = "shard long, island int, n_bins long, squares long, sizes array<int>, bins array<int>"


def _state(key: tuple, size: list[int], bins: Bins) -> pa.Table:
    place = [0] * len(size)
    for k, b in enumerate(bins):
        for i in b:
            place[i] = k
    n, squares = fitness(bins, size)
    lists = [pa.array([x], pa.list_(pa.int32())) for x in (size, place)]
    shard, island = (x.as_py() for x in key)
    return pa.table([pa.array([shard], pa.int64()), pa.array([island], pa.int32()), pa.array([n], pa.int64()), pa.array([squares], pa.int64()), *lists], names=[x.split()[0] for x in _STATE.split(", ")])


def _shards(small: DataFrame, capacity: int, shard_items: int, islands: int, epochs: int, shards: int, seed: int) -> DataFrame:
    """shard, bin and the item's columns: every shard's best packing. Only lengths travel through the epochs."""
    dealt = small.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(shards)))
    number = F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("length"), "doc_id", "piece", "start", "ids_crc32")) - 1
    items = materialize(dealt.withColumn("item", number.cast("int")), "items")

    def first(key: tuple, g: pa.Table) -> pa.Table:
        size = g["length"].to_numpy()[np.argsort(g["item"].to_numpy())].tolist()
        return _state(key, size, evolve(size, [], seed + 1000 * key[0].as_py() + key[1].as_py(), capacity))

    def next_epoch(key: tuple, g: pa.Table) -> pa.Table:
        size, elites = g["sizes"][0].as_py(), []
        for place in g.sort_by([("n_bins", "ascending"), ("squares", "ascending")])["bins"].to_pylist():
            bins: Bins = [[] for _ in range(max(place) + 1)]
            for i, b in enumerate(place):
                bins[b].append(i)
            elites.append(bins)
        return _state(key, size, evolve(size, elites, seed + 7 + 1000 * key[0].as_py() + key[1].as_py(), capacity))

    state = items.select("shard", "item", "length", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    state = state.groupBy("shard", "island").applyInArrow(first, _STATE)
    for _ in range(epochs - 1):
        ring = F.explode(F.array_distinct(F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(islands)))))
        state = state.withColumn("island", ring).groupBy("shard", "island").applyInArrow(next_epoch, _STATE)
    best = state.groupBy("shard").agg(F.min_by("bins", F.struct("n_bins", "squares", "island")).alias("bins"))
    return items.join(best.select("shard", F.posexplode("bins").alias("item", "bin")), ["shard", "item"]).select("shard", "bin", *_ITEMS)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    cut = materialize(pieces(docs, vocabulary, end_id, capacity), "pieces")
    small = cut.where(F.col("length") < capacity)
    n = small.count()
    shards = max(1, -(-n // shard_items))
    one = _shards(small, capacity, shard_items, islands, epochs, shards, 1)
    if shards > 1:
        one = materialize(one, "packed")
        fill = one.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
        poor = one.join(fill.where(F.col("fill") < int(WELL_FILLED * capacity)).drop("fill"), ["shard", "bin"], "left_semi")
        poor = materialize(poor.select(*_ITEMS, F.col("shard").alias("old"), F.col("bin").alias("old_bin")), "poor")
        m = poor.count()
        again = _shards(poor.select(*_ITEMS), capacity, shard_items, islands, epochs, max(1, -(-m // shard_items)), 2) if m else None
        # the new round is taken only where it needs no more bins than the old one did
        old_bins = poor.select("old", "old_bin").distinct().count()
        again = materialize(again, "again") if again is not None else None
        if again is not None and again.select("shard", "bin").distinct().count() <= old_bins:
            good = one.join(fill.where(F.col("fill") >= int(WELL_FILLED * capacity)).drop("fill"), ["shard", "bin"], "left_semi")
            one = good.withColumn("round", F.lit(0)).unionByName(again.withColumn("round", F.lit(1)))
    if "round" not in one.columns:
        one = one.withColumn("round", F.lit(0))
    place = Window.partitionBy("round", "shard", "bin").orderBy(F.desc("length"), "doc_id", "piece", "start").rowsBetween(Window.unboundedPreceding, -1)
    number = (F.col("shard") * 2 + F.col("round")) * 2 * shard_items * 64 + F.col("bin") * 2 + 1
    shared = one.select(*_ITEMS, number.alias("sequence_id"), F.coalesce(F.sum("length").over(place), F.lit(0)).alias("offset"))
    alone = cut.where(F.col("length") == capacity).select(*_ITEMS, (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return shared.unionByName(alone)
