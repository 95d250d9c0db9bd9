"""Byte-level BPE ids of whole texts by the tokenizers library, each distinct piece of text encoded once per worker.

The vocabulary's pattern starts a new token wherever a run of letters (with one white-space character before it)
begins or ends, whatever lies on the other side. Texts are cut there, vectorised; the pieces are looked up by a 64-bit
hash in a bounded table of ids, which counts as a hit only where all bytes are equal, and the library encodes the
pieces that the table lacks. Texts with letters beyond Latin, or with an apostrophe next to other signs, could be cut
within a token: the library gets them whole. So it does pieces of more than 256 bytes, each time.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from .bytehash import chunks, ragged, stretch_words, word_hashes

# Characters that the cutting rule covers: ASCII and the Latin letters up to U+024F.
NOT_COVERED = re.compile(r"[^\x00-\x7fªµºÀ-ÖØ-öø-ɏ]")
APOSTROPHE = re.compile(r"[!-&(-/:-@\[-`{-~\x00-\x08\x0e-\x1f\x7f]'|'[!-&(-/:-@\[-`{-~\x00-\x08\x0e-\x1f\x7f]|''")
LETTER, SPACE, OTHER = 1, 2, 0
CLASS = np.zeros(256, np.uint8)
CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100), 0x27]] = LETTER
CLASS[[*range(9, 14), 0x20]] = SPACE
SLOT_BITS, KEPT_ENTRIES, KEPT_IDS, LONGEST_PIECE = 21, 700_000, 6_000_000, 256
SEPARATOR = b"\x00"
#: What bounds a worker's memory beside the table: bytes of texts cut at once, pieces of one call of the library.
CHUNK_BYTES, CALL_PIECES = 1 << 18, 4096


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        special = [t for t in self.tokenizer.get_added_tokens_decoder().items() if t[1].special]
        self.mark_id, self.mark = (special[0][0], special[0][1].content) if special else (None, None)
        self.key, self.entry = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int32)
        self._allocate()
        self._empty()

    def _allocate(self) -> None:
        # a slot's key is the piece's first word; size in bytes, and all words with their place
        self.start, self.length, self.size, self.word_at = (np.zeros(1024, np.int32) for _ in range(4))
        self.ids, self.words = np.zeros(4096, np.uint32), np.zeros(4096, np.uint64)

    def _empty(self) -> None:
        """Forget all pieces; the arrays stay, unless a very long text has made them larger than others need."""
        if len(self.start) > 2 * KEPT_ENTRIES or max(len(self.ids), len(self.words)) > 2 * KEPT_IDS:
            self._allocate()
        self.entry.fill(0)  # entry 0, of no size, is that of an empty slot
        self.entries, self.used, self.words_used = 1, 0, 0

    def _direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all pieces, one after another, and their counts.

        A special token between the pieces makes it one call: the library encodes what lies between on its own.
        """
        if not self.mark or len(pieces) < 2 or any(self.mark in p for p in pieces):
            got = self._direct(pieces)
            return np.concatenate([*got, np.zeros(0, np.uint32)]), np.array([len(x) for x in got], np.int64)
        self.tokenizer.encode_special_tokens = False
        try:
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(pieces)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        finally:
            self.tokenizer.encode_special_tokens = True
        ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
        return ids[ids != self.mark_id], np.diff(ends, prepend=-1) - 1

    def _learn(self, hashes: np.ndarray, pieces: list[str], sizes: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        calls = [self._pieces(pieces[k : k + CALL_PIECES]) for k in range(0, len(pieces), CALL_PIECES)]
        ids, n = (np.concatenate(x) for x in zip(*calls))
        first, end = self.entries, self.entries + len(pieces)
        while end > len(self.start):
            self.start, self.length, self.size, self.word_at = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.size, self.word_at))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.words_used + len(words) > len(self.words):
            self.words = np.concatenate([self.words, np.zeros_like(self.words)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[first:end] = self.used + np.cumsum(n) - n
        self.length[first:end] = n
        self.words[self.words_used : self.words_used + len(words)] = words
        self.word_at[first:end] = self.words_used + np.cumsum(counts) - counts
        self.size[first:end] = sizes
        new = np.arange(first, end)
        # a piece goes to the first of its two slots, if that is taken to the second, where the last to come stays
        kept = np.flatnonzero(sizes <= LONGEST_PIECE)
        one, other = self._slots(hashes[kept])
        slot = np.where(self.size[self.entry[one]] > 0, other, one)
        self.entry[slot] = new[kept]
        self.key[slot] = words[(np.cumsum(counts) - counts)[kept]]
        self.entries, self.used, self.words_used = end, self.used + len(ids), self.words_used + len(words)
        return new

    @staticmethod
    def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64), (h & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)

    def _same(self, slot: np.ndarray, sizes: np.ndarray, words: np.ndarray, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each piece's slot, and whether it holds the same bytes."""
        entry = self.entry[slot].astype(np.int64)
        same = (self.key[slot] == words[at]) & (self.size[entry] == sizes)
        long = np.flatnonzero(same & (counts > 1))
        if len(long):
            n = counts[long]
            equal = self.words[ragged(self.word_at[entry[long]], n)] == words[ragged(at[long], n)]
            same[long] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        return entry, same

    def _known(self, h: np.ndarray, sizes: np.ndarray, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, other = self._slots(h)
        at = np.cumsum(counts) - counts
        entry, same = self._same(one, sizes, words, at, counts)
        rest = np.flatnonzero(~same)
        if len(rest):
            entry[rest], same[rest] = self._same(other[rest], sizes[rest], words, at[rest], counts[rest])
        return entry, same

    def _chunk(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.entries > KEPT_ENTRIES or max(self.used, self.words_used) > KEPT_IDS:
            self._empty()
        data = np.frombuffer(SEPARATOR + SEPARATOR.join(texts) + SEPARATOR, np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        marks = np.concatenate([[0], np.cumsum(sizes)])  # of the separators
        kind = CLASS[data]
        letter, space = kind == LETTER, kind == SPACE
        begins = np.zeros(len(data), bool)
        begins[1:] = letter[1:] != letter[:-1]
        begins[1:] &= ~(letter[1:] & space[:-1])
        begins[:-1] |= space[:-1] & letter[1:]
        begins[marks] = True
        begins[marks[:-1] + 1] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        real = np.ones(len(starts), bool)
        real[np.searchsorted(starts, marks)] = False
        starts, ends = starts[real], ends[real]
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        sizes = ends - starts
        words, counts = stretch_words(data, starts, ends)
        h = word_hashes(words, counts, sizes)
        entry, same = self._known(h, sizes, words, counts)
        miss = np.flatnonzero(~same)
        if len(miss):
            raw = data.tobytes()
            pieces: dict[bytes, int] = {}
            number = np.array([pieces.setdefault(raw[i:j], len(pieces)) for i, j in zip(starts[miss].tolist(), ends[miss].tolist())], np.int64)
            first = miss[np.unique(number, return_index=True)[1]]  # a place of each distinct piece
            own = words[ragged((np.cumsum(counts) - counts)[first], counts[first])]
            entry[miss] = self._learn(h[first], [x.decode() for x in pieces], sizes[first], own, counts[first])[number]
        n = self.length[entry]
        per_text = np.zeros(len(texts) + 1, np.int64)
        per_text[1:] = np.cumsum(n)[np.searchsorted(starts, marks[1:]) - 1]
        return self.ids[ragged(self.start[entry], n)], np.diff(np.maximum.accumulate(per_text))

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        cut = []
        for k, t in enumerate(texts):
            if not t:
                continue
            if (t.isascii() or not NOT_COVERED.search(t)) and "\x00" not in t and not ("'" in t and APOSTROPHE.search(t)):
                cut.append((k, t.encode()))
            else:
                out[k] = self._direct([t])[0]
        raw = [t for _, t in cut]
        for i, j in chunks(raw, CHUNK_BYTES):
            ids, n = self._chunk(raw[i:j])
            for (k, _), part in zip(cut[i:j], np.split(ids, np.cumsum(n)[:-1])):
                out[k] = part
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file on this machine; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
