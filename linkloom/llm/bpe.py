"""Byte-level BPE pieces: the split of a text and the heap-and-linked-list merge."""

from __future__ import annotations

import functools
import heapq
import json

import regex

# Fixed values of the public byte-level tokenizer family.
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Bytes that stand for themselves in the vocabulary file; the others are shifted beyond 255.
PRINTABLE_RANGES = ((33, 126), (161, 172), (174, 255))

#: Entries a worker keeps of pieces it has merged; the store is emptied when full.
PIECE_STORE = 400_000
#: Pieces longer than this are merged anew each time, so the store's memory stays bounded.
STORED_PIECE_CHARS = 64


def byte_characters() -> list[str]:
    """The vocabulary's character for each byte value."""
    own = {b for low, high in PRINTABLE_RANGES for b in range(low, high + 1)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(shifted)) for b in range(256)]


class ByteBPE:
    """Counts of tokens per text, without ever making identifiers of the tokens.

    A piece starts as one symbol per UTF-8 byte in a doubly linked list. A heap holds the
    mergeable adjacent pairs by (rank, position); the lowest is popped and merged, its two new
    neighbour pairs are pushed, and entries whose symbols have changed meanwhile are skipped.
    The count is the number of bytes less the number of merges.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.symbols = [vocab[c] for c in byte_characters()]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(PIECE_PATTERN).findall
        self.store: dict[str, int] = {}

    def merged(self, piece: bytes) -> int:
        """Tokens of one piece."""
        merges, ids = self.merges, [self.symbols[b] for b in piece]
        size = len(ids)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = []
        for i in range(size - 1):
            found = merges.get((ids[i], ids[i + 1]))
            if found:
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(heap)
        left = size
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= size or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            left -= 1
            if k < size:
                before[k] = i
                found = merges.get((made, ids[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, made, ids[k], found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((ids[h], made))
                if found:
                    heapq.heappush(heap, (found[0], h, ids[h], made, found[1]))
        return left

    def _ordinary(self, text: str) -> int:
        store, total = self.store, 0
        for piece in self.pieces(text):
            n = store.get(piece)
            if n is None:
                n = self.merged(piece.encode("utf-8"))
                if len(piece) <= STORED_PIECE_CHARS:
                    if len(store) >= PIECE_STORE:
                        store.clear()
                    store[piece] = n
            total += n
        return total

    def count(self, text: str) -> int:
        """Tokens of a text; each special string inside it is one token."""
        if self.special is None:
            return self._ordinary(text)
        total, at = 0, 0
        for found in self.special.finditer(text):
            total += self._ordinary(text[at : found.start()]) + 1
            at = found.end()
        return total + self._ordinary(text[at:] if at else text)


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> ByteBPE:
    """One tokenizer per worker process and vocabulary file."""
    return ByteBPE(path)
