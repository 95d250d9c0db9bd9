"""Interleaved entropy coders over byte streams: 32 lanes of 256 symbols a group, vectorised over lanes and groups.

States live in [2^15, 2^31); a lane gives out 16-bit words. Within a step the lanes of a group go in order, so a group
has one list of words; decoding runs backwards and the highest lane takes the last word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .frequency import apportion_array

LANES, LANE_SYMBOLS, TOTAL, K, WORD = 32, 256, 2048, 16, 16
GROUP = LANES * LANE_SYMBOLS
LEAST = K * TOTAL


@dataclass(frozen=True)
class Options:
    """Frequencies, the renormalisation base b (a power of two) and the multiple k of the total."""

    freq: tuple[int, ...]
    b: int = 1 << WORD
    k: int = K

    def __post_init__(self) -> None:
        total = sum(self.freq)
        if len(self.freq) < 2 or min(self.freq) < 0 or total <= 0:
            raise ValueError("two symbols or more with a positive total are needed")
        if self.b < 2 or self.b & (self.b - 1) or self.k < 1 or self.b * self.k * total > 1 << 32:
            raise ValueError("b must be a power of two, and b * k * total must fit 32 bits")

    @property
    def total(self) -> int:
        return sum(self.freq)

    @classmethod
    def filled(cls, freq: tuple[int, ...], b: int = 0, k: int = 0) -> Options:
        """Options whose zero fields take the least that works: b of 2, k of 1. Others must be valid."""
        return cls(freq, b or 2, k or 1)


def lane_state(symbols: Column, options: Options) -> Column:
    """End state, number of words and their sum of one lane's array of symbols, as a fold in SQL expressions."""
    freq = F.array(*(F.lit(f).cast("long") for f in options.freq))
    first = F.array(*(F.lit(sum(options.freq[:k])).cast("long") for k in range(len(options.freq))))
    bits, limit, total = options.b.bit_length() - 1, options.b * options.k, options.total

    def step(acc: Column, s: Column) -> Column:
        f, c = F.get(freq, s), F.get(first, s)
        full = acc["state"] >= f * limit
        x = F.when(full, F.shiftright(acc["state"], bits)).otherwise(acc["state"])
        word = F.when(full, acc["state"].bitwiseAND(options.b - 1)).otherwise(0)
        state = F.call_function("div", x, f) * total + c + x % f
        return F.struct(state.alias("state"), (acc["words"] + full.cast("long")).alias("words"), (acc["added"] + word).alias("added"))

    start = F.struct(F.lit(options.k * total).cast("long").alias("state"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("added"))
    return F.aggregate(symbols, start, step)


def shuffled_slots(freq: np.ndarray, seed: int = 0) -> np.ndarray:
    """Symbol of each slot, the slots dealt in a seeded random order (the tabled coder)."""
    return np.random.default_rng(seed).permutation(np.repeat(np.arange(len(freq)), freq))


class Table:
    """Symbol, frequency and offset of each slot; `ranges` keeps a symbol's slots together, else they are shuffled."""

    def __init__(self, freq: np.ndarray, ranges: bool = True, seed: int = 0) -> None:
        self.freq = np.asarray(freq, dtype=np.int64)
        self.total = int(self.freq.sum())
        self.symbol = np.repeat(np.arange(len(self.freq)), self.freq) if ranges else shuffled_slots(self.freq, seed)
        first = np.cumsum(self.freq) - self.freq
        by_symbol = np.argsort(self.symbol, kind="stable")
        self.slot = by_symbol  # slots of symbol 0, of symbol 1, ...
        self.first = first
        self.offset = np.empty(self.total, np.int64)
        self.offset[by_symbol] = np.arange(self.total) - np.repeat(first, self.freq)


def encode_groups(symbols: np.ndarray, table: Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """symbols (groups, lanes, n): end states (groups, lanes) and the words of each group."""
    groups, lanes, n = symbols.shape
    least = K * table.total
    state = np.full((groups, lanes), least, np.int64)
    out = np.zeros((groups, n, lanes), np.int64)
    sent = np.zeros((groups, n, lanes), bool)
    for i in range(n):
        s = symbols[:, :, i]
        f = table.freq[s]
        full = state >= (f * K << WORD)
        out[:, i], sent[:, i] = state & 0xFFFF, full
        state = np.where(full, state >> WORD, state)
        state = state // f * table.total + table.slot[table.first[s] + state % f]
    return state, [out[g][sent[g]] for g in range(groups)]


def decode_groups(state: np.ndarray, words: list[np.ndarray], n: int, table: Table, spare: int = 0) -> np.ndarray:
    """The symbols (groups, lanes, n) back; up to `spare` words before a group's first may be alignment."""
    groups, lanes = state.shape
    least = K * table.total
    state = state.astype(np.int64)
    left = np.array([len(w) for w in words])
    flat = np.concatenate([np.zeros(1, np.int64), *words]).astype(np.int64)
    start = 1 + np.cumsum(left) - left
    out = np.zeros((groups, lanes, n), np.int64)
    for i in range(n - 1, -1, -1):
        slot = state % table.total
        s = table.symbol[slot]
        out[:, :, i] = s
        state = state // table.total * table.freq[s] + table.offset[slot]
        low = state < least
        behind = np.cumsum(low[:, ::-1], axis=1)[:, ::-1]  # of the lanes from this one up
        at = np.where(low, start[:, None] + left[:, None] - behind, 0)
        state = np.where(low, (state << WORD) | flat[at], state)
        left = left - low.sum(axis=1)
    if (left < 0).any() or (left > spare).any() or (state != least).any():
        raise ValueError("the stream does not unwind to its first state")
    return out


def encode_stream(data: np.ndarray, freq: np.ndarray | None = None) -> tuple[np.ndarray, bytes]:
    """Frequencies (256, summing to 2048) and the coded stream of bytes whose number is a multiple of 8192.

    The frequencies are those of the data unless they are given, as for a piece of a longer stream. End offsets of the groups, counted from the stream's start; then of each group its words, two zero bytes before
    them where that aligns the states, and the 32 states.
    """
    if len(data) % GROUP:
        raise ValueError(f"length {len(data)} is no multiple of {GROUP}")
    if not len(data):
        return np.zeros(256, np.int64), b""
    if freq is None:
        freq = apportion_array(np.bincount(data, minlength=256), TOTAL)
    state, words = encode_groups(data.reshape(-1, LANES, LANE_SYMBOLS).astype(np.int64), Table(freq))
    parts = [(b"\0\0" if len(w) % 2 else b"") + w.astype("<u2").tobytes() + s.astype("<u4").tobytes() for w, s in zip(words, state)]
    ends = 4 * len(parts) + np.cumsum([len(p) for p in parts])
    return freq, ends.astype("<u4").tobytes() + b"".join(parts)


def decode_stream(freq: np.ndarray, raw: bytes, length: int) -> np.ndarray:
    if not length:
        return np.zeros(0, np.uint8)
    groups = length // GROUP
    ends = np.frombuffer(raw, "<u4", groups).astype(np.int64)
    starts = np.append(4 * groups, ends[:-1])
    state = np.stack([np.frombuffer(raw, "<u4", LANES, e - 4 * LANES) for e in ends])
    words = [np.frombuffer(raw[s : e - 4 * LANES], "<u2") for s, e in zip(starts, ends)]
    return decode_groups(state, words, LANE_SYMBOLS, Table(freq), spare=1).reshape(-1).astype(np.uint8)


def encode_shorts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each 64-bit value; those beyond -127..127 become the escape 128 and go aside whole, in order."""
    wide = (values > 127) | (values < -127)
    return np.where(wide, 128, values & 255).astype(np.uint8), values[wide].astype("<i8")


def decode_shorts(symbols: np.ndarray, aside: np.ndarray) -> np.ndarray:
    out = symbols.astype(np.int8).astype(np.int64)
    out[symbols == 128] = aside
    return out


#: Symbols of one 16-bit stream: whole groups whose counts and end offsets stay below 2^16.
SHORT_LIMIT = 7 * GROUP


def encode_short_stream(values: np.ndarray) -> bytes:
    """The coded stream of up to SHORT_LIMIT values of 16 bits, filled up with zeros to whole groups.

    Little endian: 256 counts, the number of values beyond 127 and these, the number of groups and the bytes of each,
    16 bits each; then the groups.
    """
    values = np.asarray(values, dtype=np.int64)
    if not len(values) or len(values) > SHORT_LIMIT or values.min() < -(1 << 15) or values.max() >= 1 << 15:
        raise ValueError(f"1 to {SHORT_LIMIT} values of 16 bits are needed")
    symbols, aside = encode_shorts(np.pad(values, (0, -len(values) % GROUP)))
    counts = np.bincount(symbols, minlength=256)
    raw = encode_stream(symbols)[1]
    groups = len(symbols) // GROUP
    ends = np.frombuffer(raw, "<u4", groups).astype(np.int64)
    sizes = np.diff(ends, prepend=4 * groups)
    words = [counts, [len(aside)], aside, [groups], sizes]
    return b"".join(np.asarray(w, dtype=np.int64).astype("<u2").tobytes() for w in words) + raw[4 * groups :]


def short_header(raw: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """The values set aside, the bytes of each group, and those of the header."""
    at = 514
    n = int(np.frombuffer(raw, "<u2", 1, at - 2)[0])
    aside = np.frombuffer(raw, "<i2", n, at)
    at += 2 * n + 2
    groups = int(np.frombuffer(raw, "<u2", 1, at - 2)[0])
    return aside, np.frombuffer(raw, "<u2", groups, at).astype(np.int64), at + 2 * groups


def decode_short_stream(raw: bytes) -> np.ndarray:
    """The values back, with the zeros that fill the last group."""
    aside, sizes, head = short_header(raw)
    freq = apportion_array(np.frombuffer(raw, "<u2", 256).astype(np.int64), TOTAL)
    ends = 4 * len(sizes) + np.cumsum(sizes)
    symbols = decode_stream(freq, ends.astype("<u4").tobytes() + raw[head:], len(sizes) * GROUP)
    return decode_shorts(symbols, aside.astype(np.int64))
