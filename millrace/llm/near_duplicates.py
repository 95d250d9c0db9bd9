"""N-gram Jaccard join in the metric space of shingle sets, exact.

A document's set is its distinct `words`-word shingles; documents link when the sets' similarity reaches the threshold.
Jaccard distance is a metric, but most documents are at distance 1 of every pivot, so pivots are chosen where they can
be near, by exact counts over the whole corpus:

1. Documents with equal sets are one class; the one with the smallest id stands for it.
2. Every shingle of a fixed half of the hash space is counted over all classes. A set of which too many counted
   shingles occur nowhere else can have no partner and leaves.
3. Of two linked sets, the shingles that one has and the other lacks are fewer than a fifth, so in any common order
   both have a shared shingle among their first fifth. The order is from rare to frequent. The smallest document with a
   shingle among its first fifth is the pivot of all documents that have it there: each document is replicated to
   the regions of all its pivots, and every linked pair meets in a region.
4. Within a region the metric-space join runs. Pivots are drawn by a hash, those near another left out; each document
   belongs to the Voronoi cell of its nearest pivot and is replicated to every cell whose pivot is at most twice the
   threshold's distance farther: by the triangle inequality a linked pair meets in the cell of either's nearest pivot.
   Documents linked to the same pivot carry its label, since they are connected; cells of one label are done. Cells join
   recursively: as tables while they hold more than `region_rows`, each level a shuffle of ids, then within a task.
   Documents far from every pivot, which more than three windows hold, are compared with all of their region where they are few;
   a region that cells cannot divide is compared block by block. Distances to pivots so far still rule pairs out.
5. Links become connected components by star contraction.

Words are runs of `[^\\x20\\x09-\\x0D]+` with A-Z lowered; fewer words than a shingle form one; a text without words has
an empty set and no links, nor has a row without doc_id (its component is null). Rows that repeat a doc_id are one
document and share a component. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import MIX_1, MIX_2, chunks, mix, stretch_hashes
from .common import fresh, materialize, partitions, ship, spread_join
from .components import components

WORDS, THRESHOLD, KEY_BYTES = 5, 80, 6  # the threshold in hundredths
BLOCK_BYTES, BUCKET_BYTES, REGION_ROWS = 4 << 20, 24 << 20, 1024
PIVOTS, LEAF_ROWS, MOST_COPIES, MOST_LEVELS = 16, 64, 3, 8
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
JOIN = np.uint64(0x9FB21C651E98DF25)
FREQUENCY_STEPS = np.array([2, 33, 1025])


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    for i, j in chunks(texts):
        data = LOWER[np.frombuffer(b" " + b" ".join(texts[i:j]) + b" ", np.uint8)]
        space = SPACE[data]
        starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
        w = stretch_hashes(data, starts, ends)
        begins = np.cumsum([1] + [len(t) + 1 for t in texts[i:j]])
        first = np.searchsorted(starts, begins)
        h = w[: max(0, len(w) - words + 1)].copy()
        for k in range(1, words):
            h = h * JOIN + w[k : len(h) + k]
        h = mix(h)
        for t in range(j - i):
            a, b = first[t], first[t + 1]
            if b - a >= words:
                out[i + t] = np.unique(h[a : b - words + 1])
            elif b > a:
                whole = np.array([b - a], np.uint64)
                for x in w[a:b]:
                    whole = whole * JOIN + x
                out[i + t] = mix(whole ^ MIX_2)
    return out


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed integers."""
    if not len(s):
        return 0, 0
    return int(mix(s ^ MIX_1).sum().view(np.int64)), int(np.bitwise_xor.reduce(mix(s ^ MIX_2)).view(np.int64))


def allowed(n: np.ndarray | int, threshold: int = THRESHOLD):
    """How many shingles of a set of n may be missing in a linked one."""
    return n - -(-threshold * n // 100)


def _keys(s: np.ndarray) -> np.ndarray:
    """The counted shingles of a set: the lower half of the hash space, shifted so that they fill it."""
    return s[: np.searchsorted(s, np.uint64(1 << 63))] << np.uint64(1)


def _to_bytes(keys: np.ndarray) -> bytes:
    return (keys >> np.uint64(64 - 8 * KEY_BYTES)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _from_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BYTES)
    return out.reshape(-1).view("<u8")


def linked(common: np.ndarray, n: np.ndarray, m: np.ndarray | int, threshold: int = THRESHOLD) -> np.ndarray:
    return 100 * common >= threshold * (n + m - common)


class Region:
    """Exact links among the sets of one region, as stars of its connected documents.

    Documents with the same label, if not 0, count as connected.
    """

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], threshold: int, labels: np.ndarray | None = None) -> None:
        self.ids, self.sets, self.threshold = ids, sets, threshold
        self.size = np.array([len(s) for s in sets], np.int64)
        self.flat = np.concatenate(sets)
        self.at = np.cumsum(self.size) - self.size
        self.parent = np.arange(len(ids))
        self.reach = 1 - threshold / 100 + 1e-9
        if labels is not None and labels.any():
            _, first, number = np.unique(labels, return_index=True, return_inverse=True)
            self.parent = np.where(labels != 0, first[number], self.parent)
        self.distances: list[np.ndarray] = []

    def common(self, pivot: int, rows: np.ndarray) -> np.ndarray:
        own = self.sets[pivot]
        if len(rows) == len(self.sets):
            flat, at = self.flat, self.at
        else:
            flat = np.concatenate([self.sets[r] for r in rows])
            at = np.cumsum(self.size[rows]) - self.size[rows]
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        return np.add.reduceat(hit.astype(np.int64), at)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def join(self, a: int, rows: np.ndarray) -> None:
        root = self.roots()
        merged = np.unique(np.append(root[rows], root[a]))
        self.parent[np.isin(root, merged)] = merged.min()

    def visit(self, pivot: int, rows: np.ndarray) -> np.ndarray:
        """Compare the pivot with rows, link what reaches the threshold and keep the distances; returns the linked."""
        both = self.common(pivot, rows)
        distance = np.full(len(self.ids), np.nan)
        distance[rows] = 1 - both / (self.size[rows] + self.size[pivot] - both)
        self.distances = [*self.distances[-7:], distance]
        near = rows[linked(both, self.size[rows], self.size[pivot], self.threshold)]
        self.join(pivot, near)
        return near

    def window(self, pivot: int, rows: np.ndarray) -> np.ndarray:
        """The rows that the sizes, the distances to earlier pivots and the links so far leave for the pivot."""
        n = self.size[pivot]
        rows = rows[(100 * self.size[rows] >= self.threshold * n) & (100 * n >= self.threshold * self.size[rows])]
        for d in self.distances:
            gap = np.abs(d[rows] - d[pivot])
            rows = rows[~(gap > self.reach)]  # unknown distances rule nothing out
        root = self.roots()
        return rows[root[rows] != root[pivot]]

    def compare(self, some: np.ndarray, others: np.ndarray) -> None:
        """Link every one of some with every one of others that the windows leave.

        Of two documents that are not connected yet, one at least is not among the largest connected group.
        """
        root = self.roots()
        names, counts = np.unique(root[np.append(some, others)], return_counts=True)
        largest = names[np.argmax(counts)]
        sides = [(some, others)] if some is others else [(some, others), (others, some)]
        for one, other in sides:
            for y in one[root[one] != largest]:
                todo = self.window(y, other[other != y])
                if self.distances:
                    todo = todo[np.argsort(np.abs(self.distances[0][todo] - self.distances[0][y]), kind="stable")]
                while len(todo):
                    self.visit(y, todo[:64])
                    todo = self.window(y, todo[64:])

    def to_pivots(self, pivots: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distances (pivot, row); what reaches the threshold is linked."""
        out = np.empty((len(pivots), len(rows)))
        for k, p in enumerate(pivots):
            self.visit(int(p), rows)
            out[k] = self.distances[-1][rows]
        return out

    def net(self, drawn: np.ndarray) -> np.ndarray:
        """Those of the drawn rows that lie apart, so that few windows reach over several cells."""
        distance, chosen = self.to_pivots(drawn, drawn), []
        for k in range(len(drawn)):
            if all(distance[j, k] > 2 * self.reach for j in chosen):
                chosen.append(k)
        return drawn[chosen]

    def solve(self, rows: np.ndarray | None = None) -> None:
        """All links among the rows, by cells and windows while these divide them."""
        rows = np.arange(len(self.ids)) if rows is None else rows
        root = self.roots()[rows]
        if (root == root[0]).all():
            return
        if len(rows) <= LEAF_ROWS:
            self.compare(rows, rows)
            return
        cells = in_cells(self.to_pivots(self.net(rows[:: -(-len(rows) // PIVOTS)]), rows), self.reach)
        wide = cells.sum(axis=0) > MOST_COPIES  # far from every pivot, so within too many windows
        cells = cells & ~wide
        if wide.mean() > 0.5 or cells.sum(axis=1).max() > 0.9 * len(rows):
            self.compare(rows, rows)
            return
        if wide.any():
            self.compare(rows[wide], rows)
        for cell in cells:
            if cell.any():
                self.solve(rows[cell])

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """Each document with the smallest id of its connected documents, where that is another one."""
        root = self.roots()
        least = np.full(len(root), np.iinfo(np.int64).max)
        np.minimum.at(least, root, self.ids)
        other = least[root] != self.ids
        return self.ids[other], least[root][other]


def in_cells(distance: np.ndarray, reach: float) -> np.ndarray:
    """Which rows (second axis) are in the cell of each pivot (first axis) or in its window."""
    return distance <= distance.min(axis=0) + 2 * reach


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in column.to_pylist()]


def groups(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, region_rows: int = REGION_ROWS) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, parts = max(1, -(-total // block_bytes)), partitions(spark)
    buckets = 1 << max(0, -(-total // bucket_bytes) - 1).bit_length()
    shift = np.uint64(64 - (buckets - 1).bit_length()) if buckets > 1 else None
    block_of = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block")

    def own_sets(block: pa.Table) -> tuple[list, list[np.ndarray]]:
        return block["doc_id"].to_pylist(), shingle_sets([(t or "").encode() for t in block["text"].to_pylist()], words)

    def digest(batches):
        for b in batches:
            ids, sets = own_sets(pa.Table.from_batches([b]))
            d = [set_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64())], ["doc_id", "n", "a", "b"])

    def chosen(ids, sets, answers: pa.Table) -> list[tuple[int, np.ndarray]]:
        """The sets of the block that stand for their class, once each."""
        stand = set(zip(answers["doc_id"].to_pylist(), answers["a"].to_pylist(), answers["b"].to_pylist()))
        out = {}
        for doc, s in zip(ids, sets):
            if len(s) and (key := (doc, *set_digest(s))) in stand:
                out[key] = (doc, s)
        return list(out.values())

    def send_counts(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        names = {"bucket": pa.int64(), "block": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}
        own = [_keys(s) for _, s in chosen(*own_sets(block), answers)] if block.num_rows and answers.num_rows else []
        if not sum(map(len, own)):
            return pa.table({n: pa.array([], t) for n, t in names.items()})
        keys, counts = np.unique(np.concatenate(own), return_counts=True)
        bucket = (keys >> shift).astype(np.int64) if shift is not None else np.zeros(len(keys), np.int64)
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        out = [(int(bucket[i]), _to_bytes(keys[i:j]), np.minimum(counts[i:j], 65535).astype("<u2").tobytes()) for i, j in zip(first, np.append(first[1:], len(keys)))]
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int64()), "block": pa.array([key[0].as_py()] * len(out), pa.int64()), "keys": pa.array([x[1] for x in out], pa.binary()), "counts": pa.array([x[2] for x in out], pa.binary())})

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        own = [_from_bytes(x) for x in rows["keys"].to_pylist()]
        unique, inverse = np.unique(np.concatenate(own), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([np.frombuffer(x, "<u2") for x in rows["counts"].to_pylist()])).astype(np.int64)
        out, at = [], 0
        for x in own:
            f = total[inverse[at : at + len(x)]]
            at += len(x)
            out.append((x[f > 1].astype("<u8").tobytes(), np.minimum(f[f > 1], 65535).astype("<u2").tobytes()))
        return pa.table({"block": rows["block"], "keys": pa.array([x[0] for x in out], pa.binary()), "counts": pa.array([x[1] for x in out], pa.binary())})

    def place(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        """All rows' sizes and digests; of the sets that may have a partner also the set and its region shingles."""
        ids, sets = own_sets(block)
        known = answers.filter(answers["keys"].is_valid())
        keys = np.frombuffer(b"".join(known["keys"].to_pylist()), "<u8")
        counts = np.frombuffer(b"".join(known["counts"].to_pylist()), "<u2").astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        out, told = [], set()
        stand = {(doc, *set_digest(s)): s for doc, s in chosen(ids, sets, answers.filter(answers["a"].is_valid()))} if answers.num_rows else {}
        for doc, s in zip(ids, sets):
            d = set_digest(s)
            row = (doc, len(s), *d, None, None)
            if (doc, *d) in stand and (doc, *d) not in told:
                told.add((doc, *d))
                top = _keys(s) >> np.uint64(64 - 8 * KEY_BYTES)
                f = np.ones(len(top), np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, top), len(keys) - 1)
                    f = np.where(keys[at] == top, counts[at], 1)
                free = int(allowed(len(s), threshold))
                if (f > 1).sum() >= len(top) - free:
                    rank = np.append(np.searchsorted(FREQUENCY_STEPS, f, side="right"), np.full(len(s) - len(top), len(FREQUENCY_STEPS) + 1))
                    prefix = np.lexsort((s, rank))[: free + 1]
                    prefix = prefix[rank[prefix] > 0]
                    if len(prefix):
                        row = (doc, len(s), *d, s.astype("<u8").tobytes(), s[prefix].view(np.int64).tolist())
            out.append(row)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=["doc_id", "n", "a", "b", "shingles", "prefix"])

    dealt = docs.where("doc_id is not null").withColumn("block", block_of).repartition(parts, "block")
    digests = dealt.select("doc_id", "text").mapInArrow(digest, "doc_id long, n long, a long, b long")
    stand = digests.where("n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("doc_id")).select(block_of, "doc_id", "a", "b").repartition(parts, "block")
    sent = dealt.groupBy("block").cogroup(stand.groupBy("block")).applyInArrow(send_counts, "bucket long, block long, keys binary, counts binary")
    counts = sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(count, "block long, keys binary, counts binary").repartition(parts, "block")
    answers = stand.select("block", "doc_id", "a", "b", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("counts"))
    answers = answers.unionByName(counts.select("block", *(F.lit(None).cast("long").alias(c) for c in ("doc_id", "a", "b")), "keys", "counts"))
    placed = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(place, "doc_id long, n long, a long, b long, shingles binary, prefix array<long>")
    placed = materialize(placed, "shingles")

    found = region_links(placed.where("shingles is not null"), threshold, region_rows)
    classes = placed.where("n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("stand"), F.count("*").alias("copies"))
    classes = materialize(classes.where("copies > 1"), "copies")
    rows = spread_join(placed.select("doc_id", "n", "a", "b"), classes, ["n", "a", "b"], "copies", "left")
    rows = materialize(rows.select("doc_id", "n", F.coalesce("stand", F.when(F.col("n") > 0, F.col("doc_id"))).alias("stand")), "classes")
    several = rows.where("stand is not null").groupBy("doc_id").agg(F.min("stand").alias("v"), F.max("stand").alias("w")).where("v <> w")
    bridges = rows.join(several.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("stand").alias("v"))
    parts_of = components(found.unionByName(bridges))
    rows = rows.join(parts_of, rows["stand"] == parts_of["node"], "left")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "stand", "doc_id").alias("component_id"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in own_sets(pa.Table.from_batches([b]))[1]], pa.int64())], ["n_shingles"])

    rest = docs.where("doc_id is null").mapInArrow(sizes, "n_shingles long")
    null = F.lit(None).cast("long")
    return out.unionByName(rest.select(null.alias("doc_id"), "n_shingles", null.alias("component_id")))


def region_links(sets: DataFrame, threshold: int, region_rows: int) -> DataFrame:
    """Links u, v among the stored sets (doc_id, shingles, prefix): all that connects them, as stars."""
    by_shingle = materialize(sets.select("doc_id", F.explode("prefix").alias("shingle")), "prefixes")
    pivots = by_shingle.groupBy("shingle").agg(F.min("doc_id").alias("region"), F.count("*").alias("c")).where("c > 1")
    members = spread_join(by_shingle, materialize(pivots, "pivots"), ["shingle"], "c").select("region", "doc_id").distinct()
    members = members.withColumn("label", F.lit(0).cast("long"))
    shingles = sets.select("doc_id", "shingles")
    link = "u long, v long"

    def region_of(rows: pa.Table, first: int | None = None) -> Region:
        """Rows in an order that does not depend on how they arrived, the region's own document first."""
        ids, raw = rows["doc_id"].to_numpy(), rows["shingles"].to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k] != first, ids[k], raw[k]))
        return Region(ids[order], [np.frombuffer(raw[k], "<u8") for k in order], threshold, rows["label"].to_numpy()[order])

    def stars(region: Region) -> pa.Table:
        u, v = region.stars()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    def within(key: tuple, rows: pa.Table) -> pa.Table:
        region = region_of(rows, key[0].as_py())
        region.solve()
        return stars(region)

    def divide(key: tuple, rows: pa.Table, drawn: pa.Table) -> pa.Table:
        """Each row's cells, with its label; links to pivots have no region."""
        if rows.num_rows and drawn.num_rows:
            drawn = drawn.sort_by("doc_id")
            n = drawn.num_rows
            names = ["doc_id", "shingles", "label"]
            both = pa.concat_tables([drawn.select(names), rows.select(names)])
            region = Region(both["doc_id"].to_numpy(), [np.frombuffer(x, "<u8") for x in both["shingles"].to_pylist()], threshold, both["label"].to_numpy())
            every = np.arange(both.num_rows)
            # pivots connected among themselves or by their labels, the same in every part
            labelled = region.roots().copy()  # by labels alone, so the same in every part
            pivots = region.net(every[:n])
            root = labelled[pivots]
            name = np.array([region.ids[pivots][root == r].min() for r in root])
            distance = region.to_pivots(pivots, every)[:, n:]
            common = 1 - distance  # similarity of each row to each pivot, as it was compared
            near = 100 * common >= threshold - 1e-7
            cells = in_cells(distance, region.reach)
            ids, labels = region.ids[n:], both["label"].to_numpy()[n:]
            own = np.where(near.any(axis=0), name[np.argmax(near, axis=0)], labels)
            at, row = np.nonzero(cells)
            salt = int(key[0].as_py())
            names_of = np.array([hash((salt, int(p))) for p in region.ids[pivots]], np.int64)
            linked_at, linked_row = np.nonzero(near)
            other = ids[linked_row] != region.ids[pivots][linked_at]
            linked_at, linked_row = linked_at[other], linked_row[other]
            links = len(linked_row)
            return pa.table({
                "region": pa.array(np.append(names_of[at], np.zeros(links, np.int64)), pa.int64()),
                "parent": pa.array(np.full(len(at) + links, salt), pa.int64()),
                "doc_id": pa.array(np.append(ids[row], ids[linked_row]), pa.int64()),
                "label": pa.array(np.append(own[row], np.zeros(links, np.int64)), pa.int64()),
                "v": pa.array(np.append(np.full(len(at), None), region.ids[pivots][linked_at]).tolist(), pa.int64()),
            })
        return pa.table({c: pa.array([], pa.int64()) for c in ("region", "parent", "doc_id", "label", "v")})

    def between(key: tuple, rows: pa.Table) -> pa.Table:
        """Links between two blocks of a region, or within one."""
        region = region_of(rows)
        block = dict(zip(rows["doc_id"].to_pylist(), rows["block"].to_pylist()))
        of = np.array([block[i] for i in region.ids.tolist()])
        every = np.arange(len(of))
        region.to_pivots(region.net(every[:: -(-len(every) // PIVOTS)])[:8], every)
        if (of == of[0]).all():
            region.compare(every, every)
        else:
            region.compare(every[of == of[0]], every[of != of[0]])
        return stars(region)

    found = []
    for level in range(MOST_LEVELS + 1):
        members = materialize(members, "members")
        sizes = members.groupBy("region").agg(F.count("*").alias("rows"), F.min("label").alias("least"), F.max("label").alias("most"))
        sizes = materialize(sizes.where("rows > 1 and (least <> most or least = 0)").select("region", "rows"), "regions")
        members = spread_join(members, sizes, ["region"], "rows")
        small = members.where(F.col("rows") <= region_rows).join(shingles, "doc_id")
        found.append(small.select("region", "doc_id", "label", "shingles").groupBy("region").applyInArrow(within, link))
        if not sizes.where(F.col("rows") > region_rows).head(1):
            break
        deal = F.ceil(F.col("rows") / F.lit(region_rows)).cast("int")
        large = members.where(F.col("rows") > region_rows).withColumn("deal", deal).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("deal")).cast("int"))
        large = materialize(large.join(shingles, "doc_id"), "large")
        drawn = large.where(F.pmod(F.xxhash64("doc_id", "region", F.lit(level)), F.col("rows")) < PIVOTS)
        drawn = drawn.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("deal") - 1)))
        cells = large.groupBy("region", "part").cogroup(drawn.groupBy("region", "part")).applyInArrow(divide, "region long, parent long, doc_id long, label long, v long")
        cells = materialize(cells, "cells")
        found.append(cells.where("v is not null").select(F.col("doc_id").alias("u"), "v"))
        inside = cells.where("v is null")
        # a parent is divided if that copies its documents a few times at most and no cell is nearly all of it
        per_cell = inside.groupBy("parent", "region").agg(F.count("*").alias("n"))
        per_parent = per_cell.groupBy("parent").agg(F.sum("n").alias("copies"), F.max("n").alias("largest"))
        regions = sizes.where(F.col("rows") > region_rows)
        fit = regions.join(per_parent, regions["region"] == per_parent["parent"]).where((F.col("copies") <= MOST_COPIES * F.col("rows")) & (F.col("largest") <= 0.9 * F.col("rows")))
        divided = materialize(fit.select("region"), "divided") if level < MOST_LEVELS else regions.select("region").limit(0)
        # what cells cannot divide is compared block by block; documents labelled by connected pivots are not compared
        labelled = inside.groupBy("parent", "doc_id").agg(F.max("label").alias("named")).select(F.col("parent").alias("region"), "doc_id", "named")
        stuck = large.join(divided, "region", "left_anti").join(labelled, ["region", "doc_id"], "left").withColumn("label", F.coalesce("named", "label"))
        blocks = F.explode(F.sequence(F.lit(0), F.col("deal") - 1))
        stuck = stuck.withColumn("other", blocks).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
        stuck = stuck.select("region", "i", "j", "doc_id", "label", "shingles", F.col("part").alias("block"))
        found.append(stuck.groupBy("region", "i", "j").applyInArrow(between, link))
        members = inside.join(divided.withColumnRenamed("region", "parent"), "parent", "left_semi").select("region", "doc_id", "label").distinct()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the documents that are not the smallest of their group; rows without doc_id stay."""
    name = fresh(docs, "dropped_id")
    drop = groups(docs).where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(drop, docs["doc_id"] == drop[name], "left_anti")
