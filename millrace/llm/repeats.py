"""Suffix-array dedup: remove every byte that a long string of a smaller document covers, by a logarithmic index family.

A string of `width` bytes is keyed by the smallest hash among its 16-byte grams, so equal strings have equal keys and
neighbouring strings mostly share one: a document is a row of short runs of strings with the same key.

1. Documents are dealt into blocks of neighbouring ids and of like size: a range partitioning of (id, size) finds the
   first id of each block, whatever values the ids have.
2. Each block sends the distinct keys of its runs to buckets. A bucket returns to each block the keys that occur in two
   documents or more (other strings cannot repeat) and says which of them are hot, that is in over `hot_runs` documents.
3. Each block settles what repeats within it and sends the bytes of the other runs to the keys' buckets. Runs of a hot
   key may be many, each with other bytes around the repeated ones; their strings are dealt one by one, by their own
   fingerprint, each distinct string once a block.
4. A bucket takes the blocks in ascending order of ids as batches, streamed in sorted order, so that only the index of
   one bucket is held. A batch's suffixes are sorted (by a fingerprint of their first `width` bytes, since only matches
   of that depth count), merge-scanned against the levels of the index, which hold all smaller documents, and added as
   a level; levels of equal size are merged, so there are about log(batches) of them. Matches go back to the blocks,
   which cut their documents.

Matches never cross documents and are judged on the input. Null text is empty. Rows that repeat a doc_id are judged
each against smaller ids. A row without doc_id takes no part and keeps all its bytes. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import BYTE, MIX_1, chunks, mix, ragged, stretch_hashes
from .common import materialize, partitions, ship

WIDTH, GRAM, KEY_BYTES = 50, 16, 6
BLOCK_BYTES, BUCKET_BYTES, CHUNK_BYTES, HOT_RUNS = 4 << 20, 12 << 20, 1 << 18, 8192
MOST_BLOCKS, LARGEST_BLOCK = 1 << 20, 32 << 20  # blocks grow up to this size before there are more of them
STEP = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def _windows(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of `width` bytes in data: key (least gram hash) and fingerprint (hash of all the bytes)."""
    h = [BYTE[data]]  # of 1, 2, 4, 8, 16, 32 bytes
    for k in range(5):
        n = 1 << k
        h.append(h[-1][:-n] * STEP[k] + h[-1][n:])
    least, reach, grams = mix(h[4]), 1, width - GRAM + 1
    while 2 * reach <= grams:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if grams > reach:
        least = np.minimum(least[: len(least) - (grams - reach)], least[grams - reach :])
    count = len(data) - width + 1
    print_, at, bits = h[5][:count].copy(), 32, width - 32
    for k in (4, 3, 2, 1, 0):
        if bits >> k & 1:
            print_ = print_ * STEP[5] + h[k][at : at + count]
            at += 1 << k
    return least[:count] * MIX_1, mix(print_)


def runs_of(texts: list[bytes], width: int = WIDTH):
    """Of each chunk of texts: text number, start in the text, number of windows and key of every run.

    Yields (text, start, windows, key, bytes of the chunk, place in the chunk).
    """
    for i, j in chunks(texts, CHUNK_BYTES):
        data = np.frombuffer(b"".join(texts[i:j]), np.uint8)
        if len(data) < width:
            continue
        sizes = np.array([len(t) for t in texts[i:j]], np.int64)
        begins = np.cumsum(sizes) - sizes
        count = np.maximum(sizes - width + 1, 0)
        at = ragged(begins, count)  # window starts that stay within a text
        if not len(at):
            continue
        key = _windows(data, width)[0]
        text = np.repeat(np.arange(i, j), count)
        k = key[at]
        first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (text[1:] != text[:-1])))
        n = np.diff(np.append(first, len(at)))
        place = at[first]
        yield text[first], place - begins[text[first] - i], n, k[first], data, place


def _top(keys: np.ndarray) -> np.ndarray:
    return keys >> np.uint64(64 - 8 * KEY_BYTES)


def _to_bytes(tops: np.ndarray) -> bytes:
    return tops.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _from_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BYTES)
    return out.reshape(-1).view("<u8")


def _within(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def _rows(table: pa.Table) -> tuple[list[int], list[bytes]]:
    """Ids and texts of a block in an order that does not depend on how the rows arrived."""
    ids, texts = table["doc_id"].to_pylist(), [(t or "").encode() for t in table["text"].to_pylist()]
    order = sorted(range(len(ids)), key=ids.__getitem__)
    if len(set(ids)) < len(ids):
        order = sorted(order, key=lambda k: (ids[k], texts[k]))
    return [ids[k] for k in order], [texts[k] for k in order]


class Levels:
    """Sorted suffixes of all batches so far: fingerprint and key, in levels whose sizes differ by a factor."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def scan(self, prints: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Which of the suffixes, sorted by fingerprint, an earlier batch holds."""
        found = np.zeros(len(prints), bool)
        for p, k in self.levels:
            at = np.minimum(np.searchsorted(p, prints), len(p) - 1)
            found |= (p[at] == prints) & (k[at] == keys)
        return found

    def add(self, prints: np.ndarray, keys: np.ndarray) -> None:
        if not len(prints):
            return
        self.levels.append((prints, keys))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            (a, x), (b, y) = self.levels.pop(), self.levels.pop()
            p, k = np.concatenate([a, b]), np.concatenate([x, y])
            order = np.argsort(p, kind="stable")
            self.levels.append((p[order], k[order]))


def _packed(columns: list[tuple[np.ndarray, str]], raw: bytes = b"") -> bytes:
    """Columns of equal length and bytes after them, compressed; nothing where the columns are empty."""
    if not len(columns[0][0]):
        return b""
    body = b"".join(np.asarray(x, dtype=t).tobytes() for x, t in columns) + raw
    return np.array([len(columns[0][0])], "<u8").tobytes() + zstandard.ZstdCompressor(level=1).compress(body)


def _unpacked(packed: bytes, types: tuple[str, ...]) -> list[np.ndarray]:
    """The columns, and the bytes after them as an array."""
    if not packed:
        return [*(np.zeros(0, t) for t in types), np.zeros(0, np.uint8)]
    n, at, out = int(np.frombuffer(packed, "<u8", 1)[0]), 0, []
    raw = zstandard.ZstdDecompressor().decompress(packed[8:])
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return [*out, np.frombuffer(raw, np.uint8, offset=at)]


RUN = ("<u8", "<u4", "<i8", "<u4", "<u4")  # key, row, document, start, number of strings; then the bytes
STRING = ("<u8", "<u8", "<u4", "<i8", "<u4")  # key, fingerprint, row, document, start


def _spans(row, start, length) -> bytes:
    return np.stack([np.asarray(x, dtype="<u4") for x in (row, start, length)], axis=1).tobytes() if len(row) else b""


def block_starts(docs: DataFrame, block_bytes: int) -> tuple[np.ndarray, int]:
    """The first id of each block of about `block_bytes`, ascending, and the bytes of all texts; at most MOST_BLOCKS or so of them."""
    spark = docs.sparkSession
    sizes = materialize(docs.where("doc_id is not null").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    block_bytes = max(block_bytes, min(LARGEST_BLOCK, total // MOST_BLOCKS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, block, last = 0, -1, None
        for b in batches:
            if not b.num_rows:
                continue
            ids, size = b.column(0).to_numpy(), b.column(1).to_numpy()
            ends = before + np.cumsum(size)
            new_id = np.append(last is None or ids[0] != last, ids[1:] != ids[:-1])
            first = np.flatnonzero(new_id)
            number = (ends - size)[first] // block_bytes
            begins = first[np.append(block, number[:-1]) != number] if len(first) else first
            if len(first):
                block = number[-1]
            before, last = int(ends[-1]), ids[-1]
            yield pa.RecordBatch.from_arrays([pa.array(ids[begins], pa.int64())], ["first"])

    ranged = sizes.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id").mapInArrow(cut, "first long")
    return np.sort(np.array([r[0] for r in ranged.collect()], np.int64)), total


def cut_repeats(docs: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_runs: int = HOT_RUNS, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes) of each row."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    starts, total = block_starts(docs, block_bytes)
    buckets = 1 << max(0, -(-total // bucket_bytes) - 1).bit_length()
    shift = np.uint64(64 - (buckets - 1).bit_length()) if buckets > 1 else None
    parts = partitions(spark)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = np.searchsorted(starts, b.column(0).to_numpy(), side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block, pa.int64())], ["doc_id", "text", "block"])

    def bucket_of(keys: np.ndarray) -> np.ndarray:
        return (keys >> shift).astype(np.int64) if shift is not None else np.zeros(len(keys), np.int64)

    def per_bucket(bucket: np.ndarray):
        """Bounds of each bucket in a sorted bucket column."""
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        return zip(bucket[first].tolist(), first.tolist(), np.append(first[1:], len(bucket)).tolist())

    def send_keys(key: tuple, block: pa.Table) -> pa.Table:
        ids, texts = _rows(block)
        number = np.unique(np.array(ids, np.int64), return_inverse=True)[1] if ids else np.zeros(0, np.int64)
        seen = []
        for text, _, _, k, *_ in runs_of(texts, width):
            seen.append(_pairs(k, number[text]))
        k = np.concatenate([x for x, _ in seen]) if seen else np.zeros(0, np.uint64)
        d = np.concatenate([x for _, x in seen]) if seen else np.zeros(0, np.int64)
        order = np.lexsort((d, k))
        k, d = k[order], d[order]
        fresh = np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])) if len(k) else np.zeros(0, bool)
        unique, several = np.unique(k[fresh], return_counts=True)  # in how many documents each key is
        out = []
        for b, i, j in per_bucket(bucket_of(unique)):
            again = np.flatnonzero(several[i:j] > 1) + i
            out.append((b, _to_bytes(_top(unique[i:j])), _to_bytes(_top(unique[again])), several[again].astype("<u4").tobytes()))
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int64()), "block": pa.array([key[0].as_py()] * len(out), pa.int64()), "keys": pa.array([x[1] for x in out], pa.binary()), "several": pa.array([x[2] for x in out], pa.binary()), "counts": pa.array([x[3] for x in out], pa.binary())})

    def find_common(key: tuple, rows: pa.Table) -> pa.Table:
        own = [np.unique(_from_bytes(x)) for x in rows["keys"].to_pylist()]
        more, counts = _from_bytes(b"".join(rows["several"].to_pylist())), np.frombuffer(b"".join(rows["counts"].to_pylist()), "<u4")
        every = np.concatenate([*own, more])
        unique, inverse = np.unique(every, return_inverse=True)
        weight = np.concatenate([np.ones(len(every) - len(more)), np.maximum(counts, 1) - 1.0])
        known = np.bincount(inverse, weight, len(unique))
        common, hot = unique[known > 1], unique[known > hot_runs]
        answers = [pa.array([_to_bytes(x[_within(which, x)]) for x in own], pa.binary()) for which in (common, hot)]
        return pa.table({"block": rows["block"], "keys": answers[0], "hot": answers[1]})

    def send_runs(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts = _rows(block)
        common, hot = (np.sort(_from_bytes(b"".join(answers[c].to_pylist()))) for c in ("keys", "hot"))
        names = {"bucket": pa.int64(), "block": pa.int64(), "runs": pa.binary(), "strings": pa.binary(), "found": pa.binary()}
        if not len(common) or not ids:
            return pa.table({n: pa.array([], t) for n, t in names.items()})
        doc_ids, got, raws = np.array(ids, np.int64), [], []
        for text, start, n, k, data, place in runs_of(texts, width):
            hit = np.flatnonzero(_within(common, _top(k)))
            whole = stretch_hashes(data, place[hit], place[hit] + n[hit] + width - 1)  # a run may be longer than its first and last strings
            got.append((text[hit], start[hit], n[hit], k[hit], whole))
            raws.append((data, place[hit], n[hit] + width - 1))
        text, start, n, k, alike = (np.concatenate(x) for x in zip(*got))
        source = np.repeat(np.arange(len(raws)), [len(x[1]) for x in raws])
        place, size = np.concatenate([x[1] for x in raws]), np.concatenate([x[2] for x in raws])
        order = np.lexsort((start, text, alike, k))
        same = np.append(False, (alike[order][1:] == alike[order][:-1]) & (k[order][1:] == k[order][:-1]))
        leader = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        local = np.zeros(len(order), bool)  # an equal run of a smaller document lies in the block
        local[order] = doc_ids[text[order]] > doc_ids[text[order[leader]]]
        is_hot = ~local & _within(hot, _top(k))
        sent: dict[int, list[bytes]] = {}
        bucket = bucket_of(k)
        order = np.lexsort((start, text, bucket))
        for b, i, j in per_bucket(bucket[order]):
            own = order[i:j]
            done, go = own[local[own]], own[~local[own] & ~is_hot[own]]
            raw = b"".join(raws[s][0][p : p + z].tobytes() for s, p, z in zip(source[go].tolist(), place[go].tolist(), size[go].tolist()))
            runs = _packed(list(zip((k[go], text[go], doc_ids[text[go]], start[go], n[go]), RUN)), raw)
            sent[b] = [runs, b"", _spans(text[done], start[done], size[done])]
        if is_hot.any():
            go = np.flatnonzero(is_hot)
            prints = []
            for s, p, z in zip(source[go].tolist(), place[go].tolist(), size[go].tolist()):
                prints.append(_windows(raws[s][0][p : p + z], width)[1])
            prints, of = np.concatenate(prints), np.repeat(go, n[go])
            at = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(n[go]) - n[go], n[go])
            order = np.lexsort((at, text[of], k[of], prints))
            prints, of, at = prints[order], of[order], at[order]
            new = np.append(True, (prints[1:] != prints[:-1]) | (k[of][1:] != k[of][:-1]))
            least = doc_ids[text[of]][np.maximum.accumulate(np.where(new, np.arange(len(of)), 0))]
            known = doc_ids[text[of]] > least  # rows of a block are in ascending order of ids
            target = bucket_of(mix(prints))
            order = np.lexsort((at, text[of], target))
            for b, i, j in per_bucket(target[order]):
                done, go = order[i:j][known[order[i:j]]], order[i:j][~known[order[i:j]]]
                own = of[go]
                strings = _packed(list(zip((k[own], prints[go], text[own], doc_ids[text[own]], at[go]), STRING)))
                slot = sent.setdefault(b, [b"", b"", b""])
                slot[1] = strings
                slot[2] += _string_spans(text[of[done]], at[done], width)
        columns = [list(sent), [key[0].as_py()] * len(sent), *([x[c] for x in sent.values()] for c in range(3))]
        return pa.table({name: pa.array(x, t) for (name, t), x in zip(names.items(), columns)})

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by bucket, then by block, so that smaller ids come first; runs and single strings share the index."""
        bucket, index = None, Levels()
        for rows in batches:
            out = []
            for b, block, runs, strings, spans in zip(*(rows[c].to_pylist() for c in ("bucket", "block", "runs", "strings", "found"))):
                if b != bucket:
                    bucket, index = b, Levels()
                keys, row, doc, start, n, raw = _unpacked(runs, RUN)
                string_keys, string_prints, string_row, string_doc, string_at, _ = _unpacked(strings, STRING)
                prints, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if len(keys):
                    size = n.astype(np.int64) + width - 1
                    prints = _windows(raw, width)[1][ragged(np.cumsum(size) - size, n.astype(np.int64))]
                    of = np.repeat(np.arange(len(keys)), n)
                all_prints, all_keys, all_docs = np.concatenate([prints, string_prints]), np.concatenate([keys[of], string_keys]), np.concatenate([doc[of], string_doc])
                if len(all_prints):
                    order = np.lexsort((all_docs, all_prints))  # the batch's suffix array
                    p, k, d = all_prints[order], all_keys[order], all_docs[order]
                    new = np.append(True, p[1:] != p[:-1])
                    least = d[np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))]
                    known = index.scan(p, k)
                    hit = np.zeros(len(p), bool)
                    hit[order] = known | (d > least)
                    index.add(p[new & ~known], k[new & ~known])
                    spans += _window_runs(hit[: len(prints)], of, row, start, n, width)
                    single = hit[len(prints) :]
                    spans += _string_spans(string_row[single], string_at[single], width)
                out.append((block, spans))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["block", "spans"])

    def cut(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts = _rows(block)
        spans = np.frombuffer(b"".join(answers["spans"].to_pylist()), "<u4").reshape(-1, 3).astype(np.int64)
        spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
        first = np.searchsorted(spans[:, 0], np.arange(len(ids) + 1))
        out = []
        for r, (doc, text) in enumerate(zip(ids, texts)):
            own = spans[first[r] : first[r + 1]]
            merged: list[list[int]] = []
            for s, z in own[:, 1:].tolist():
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s + z)
                else:
                    merged.append([s, s + z])
            kept, at = [], 0
            for s, e in merged:
                kept.append(text[at:s])
                at = e
            left = b"".join([*kept, text[at:]])
            out.append((doc, len(text), len(text) - len(left), len(merged), hashlib.sha256(left).hexdigest(), left if keep_text else None))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    dealt = docs.where("doc_id is not null").mapInArrow(place, "doc_id long, text string, block long").repartition(parts, "block")
    keys = dealt.groupBy("block").applyInArrow(send_keys, "bucket long, block long, keys binary, several binary, counts binary")
    common = keys.repartition(parts, "bucket").groupBy("bucket").applyInArrow(find_common, "block long, keys binary, hot binary").repartition(parts, "block")
    runs = dealt.groupBy("block").cogroup(common.groupBy("block")).applyInArrow(send_runs, "bucket long, block long, runs binary, strings binary, found binary")
    spans = runs.repartition(parts, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(match, "block long, spans binary").repartition(parts, "block")
    out = dealt.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(cut, schema)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rest = docs.where("doc_id is null").select("doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), raw.alias("kept"))
    out = out.unionByName(rest)
    return out if keep_text else out.drop("kept")


def _pairs(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, document)."""
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    new = np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]))
    return k[new], d[new]


def _string_spans(row: np.ndarray, at: np.ndarray, width: int) -> bytes:
    """Spans of neighbouring single strings of a row."""
    if not len(row):
        return b""
    order = np.lexsort((at, row))
    row, at = row[order].astype(np.int64), at[order].astype(np.int64)
    new = np.append(True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1))
    first = np.flatnonzero(new)
    return _spans(row[first], at[first], np.diff(np.append(first, len(row))) + width - 1)


def _window_runs(hit: np.ndarray, of: np.ndarray, row, start, n, width: int) -> bytes:
    """Spans of bytes (row, start, length) of neighbouring matched windows of a run."""
    at = np.flatnonzero(hit)
    if not len(at):
        return b""
    new = np.append(True, (at[1:] != at[:-1] + 1) | (of[at[1:]] != of[at[:-1]]))
    first = at[new]
    count = np.diff(np.append(np.flatnonzero(new), len(at)))
    begins = np.cumsum(n.astype(np.int64)) - n
    run = of[first]
    return _spans(row[run], start[run] + first - begins[run], count + width - 1)
