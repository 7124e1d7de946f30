"""Simple-8b word-aligned integer coding, in NumPy.

A 64-bit word holds a 4-bit selector (top bits) and a 60-bit payload. Selector s of 1 to 15 packs ``COUNTS[s]`` ids
of ``WIDTHS[s]`` bits, the first id in the lowest bits. Selector 0 is the escape for an id of more than 60 bits: its
payload is the id's place in a list of escaped ids kept beside the words.

Ids are coded in blocks of ``BLOCK``; every block starts a new word, and the number of words before each
block is kept, so blocks are coded and decoded side by side. The last word of a block is padded with zeros.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tracekit.llm.common import ship

ship(__name__)

BLOCK = 512
# fixed values of the format: (ids in a word, bits of each) by selector
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
PAYLOAD = np.uint64(60)


@dataclass
class Coded:
    n: int                 # ids
    words: np.ndarray      # uint64
    offsets: np.ndarray    # uint32, words before each block
    escapes: np.ndarray    # uint64


def _selectors(ids: np.ndarray) -> np.ndarray:
    """For each place, the selector that packs most ids from there on within the block."""
    n = len(ids)
    rows, top = -(-n // BLOCK), ids.max(initial=0)
    least = np.zeros((rows, BLOCK + int(COUNTS[1])), np.uint8)  # narrowest selector of each id; none is asked for beyond a block
    narrowest = np.ones(n, np.uint8)
    for s in range(1, 16):
        if top < (limit := np.uint64(1) << np.uint64(WIDTHS[s])):
            break
        narrowest += ids >= limit
    whole = n - n % BLOCK
    least[:n // BLOCK, :BLOCK] = narrowest[:whole].reshape(-1, BLOCK)
    least[n // BLOCK:, :n - whole] = narrowest[whole:]
    best = np.where(least[:, :BLOCK] <= 15, np.uint8(15), np.uint8(0))
    widest, taken = least[:, :BLOCK].copy(), 1
    for s in range(14, 0, -1):  # a selector fits only where the next wider one does
        for j in range(taken, int(COUNTS[s])):
            np.maximum(widest, least[:, j:j + BLOCK], out=widest)
        taken, fits = int(COUNTS[s]), widest <= s
        if not fits.any():
            break
        best[fits] = s
    return best.reshape(-1)[:n].astype(np.int8)


def encode(ids: np.ndarray) -> Coded:
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    best = _selectors(ids)
    at = np.arange(0, n, BLOCK)
    end, places, blocks = np.minimum(at + BLOCK, n), [], []
    number = np.arange(len(at))
    while len(at):  # all blocks advance by one word
        places.append(at)
        blocks.append(number)
        at = at + COUNTS[best[at]]
        on = at < end
        at, end, number = at[on], end[on], number[on]
    start = np.sort(np.concatenate(places)) if places else np.empty(0, np.int64)
    per_block = np.bincount(np.concatenate(blocks)) if blocks else np.empty(0, np.int64)
    offsets = (np.cumsum(per_block) - per_block).astype(np.uint32)
    chosen = best[start].astype(np.int64)
    stop = np.minimum(np.minimum(start + COUNTS[chosen], (start // BLOCK + 1) * BLOCK), n)
    words = chosen.astype(np.uint64) << PAYLOAD
    escaped = np.flatnonzero(chosen == 0)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    for s in np.unique(chosen[chosen > 1]):
        w = np.flatnonzero(chosen == s)
        for j in range(COUNTS[s]):
            there = w[start[w] + j < stop[w]]
            words[there] |= ids[start[there] + j] << np.uint64(j * WIDTHS[s])
    return Coded(n, words, offsets, ids[start[escaped]])


def decode(coded: Coded) -> np.ndarray:
    out = np.zeros(coded.n, np.uint64)
    words, offsets = coded.words, coded.offsets.astype(np.int64)
    if not len(words):
        return out
    chosen = (words >> PAYLOAD).astype(np.int64)
    payload = words & ((np.uint64(1) << PAYLOAD) - np.uint64(1))
    upto = np.cumsum(COUNTS[chosen]) - COUNTS[chosen]
    block = np.repeat(np.arange(len(offsets)), np.diff(np.append(offsets, len(words))))
    start = upto - upto[offsets][block] + block * BLOCK
    stop = np.minimum(np.minimum(start + COUNTS[chosen], (block + 1) * BLOCK), coded.n)
    for s in np.unique(chosen):
        w = np.flatnonzero(chosen == s)
        if s == 0:
            out[start[w]] = coded.escapes[payload[w].astype(np.int64)]
            continue
        mask = (np.uint64(1) << np.uint64(WIDTHS[s])) - np.uint64(1)
        for j in range(COUNTS[s] if s > 1 else 0):
            there = w[start[w] + j < stop[w]]
            out[start[there] + j] = (payload[there] >> np.uint64(j * WIDTHS[s])) & mask
    return out
