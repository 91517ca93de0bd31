"""Simple-8b: a selector in a word's top 4 bits says how many ids of which width its other 60 bits hold.

Ids are coded in blocks, each starting with a new word, so that blocks are encoded and decoded side by side in numpy.
An id that 60 bits don't hold (or that would look like the mark) is escaped: a word of ones marks it, the next word is the
id itself. All ids below 2 ** 64 can be coded.
"""

from __future__ import annotations

import numpy as np

#: Ids per word and bits per id, by selector (as in the published format; 0 and 1 are runs of zeros).
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: The word that marks an escaped id, and the least id that is escaped.
ESCAPE, LEAST_ESCAPED = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64((1 << 60) - 1)
#: Ids in a block.
BLOCK = 1024


def encode(ids: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids in blocks (len + 1 offsets into ids) to words and the blocks' offsets into them.

    Every word takes the most ids that its block still has and a selector can hold.
    """
    n = len(ids)
    ids = ids.astype(np.uint64)
    narrow = np.full(n, 15, dtype=np.int8)
    left = (np.repeat(blocks[1:], np.diff(blocks)) - np.arange(n)).astype(np.int32)  # ids up to the block's end
    for s in range(14, -1, -1):  # from few wide ids to many narrow ones: the last that fits wins
        size, wide = int(COUNTS[s]), ids >> np.uint64(WIDTHS[s]) != 0
        if size > n or wide.all():
            break
        wides = np.concatenate([[0], np.cumsum(wide, dtype=np.int32)])
        fits = (wides[size:] == wides[: n + 1 - size]) & (left[: n + 1 - size] >= size)
        if not fits.any():
            break  # narrower ids in longer runs are rarer still
        narrow[: n + 1 - size][fits] = s
    # a block's words are found step by step, all blocks at once
    place, owner = blocks[:-1].copy(), np.arange(len(blocks) - 1)
    live = place < blocks[1:]
    place, owner = place[live], owner[live]
    starts, owned = [], []
    while len(place):
        starts.append(place)
        owned.append(owner)
        place = place + COUNTS[narrow[place]]
        live = place < blocks[owner + 1]
        place, owner = place[live], owner[live]
    if not starts:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(blocks), dtype=np.int64)
    starts, owned = np.concatenate(starts), np.concatenate(owned)
    order = np.argsort(starts, kind="stable")  # blocks follow each other, so their words do
    starts, owned = starts[order], owned[order]
    escaped = (narrow[starts] == 15) & (ids[starts] >= LEAST_ESCAPED)
    ends = np.cumsum(1 + escaped)
    word_offsets = np.concatenate([[0], np.cumsum(np.bincount(owned, 1 + escaped, minlength=len(blocks) - 1).astype(np.int64))])
    words = np.zeros(word_offsets[-1], dtype=np.uint64)
    words[ends[escaped] - 2], words[ends[escaped] - 1] = ESCAPE, ids[starts[escaped]]
    chosen = np.where(escaped, -1, narrow[starts])
    for s in range(16):
        of = np.flatnonzero(chosen == s)
        if len(of):
            word = np.full(len(of), s << 60, dtype=np.uint64)
            for k in range(int(COUNTS[s]) if WIDTHS[s] else 0):
                word |= ids[starts[of] + k] << np.uint64(k * int(WIDTHS[s]))
            words[ends[of] - 1] = word
    return words, word_offsets


def escaped_words(words: np.ndarray) -> np.ndarray:
    """The places of the words that are escaped ids. In a run of marks every second one is an id, and after an odd run the next word is."""
    ones = np.flatnonzero(words == ESCAPE)
    if not len(ones):
        return ones
    first = np.append(True, np.diff(ones) > 1)
    inside = np.arange(len(ones)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    last = np.append(first[1:], True)
    return np.sort(np.concatenate([ones[inside % 2 == 1], ones[last & (inside % 2 == 0)] + 1]))


def decode(words: np.ndarray) -> np.ndarray:
    """The ids of words, of any number of blocks."""
    raw = escaped_words(words)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    counts[raw], selector[raw] = 1, -1
    counts[raw - 1], selector[raw - 1] = 0, -1
    ends = np.cumsum(counts)
    ids = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    for s in range(2, 16):
        of = np.flatnonzero(selector == s)
        if len(of):
            at, mask = ends[of] - COUNTS[s], np.uint64((1 << int(WIDTHS[s])) - 1)
            for k in range(int(COUNTS[s])):
                ids[at + k] = (words[of] >> np.uint64(k * int(WIDTHS[s]))) & mask
    ids[ends[raw] - 1] = words[raw]
    return ids
