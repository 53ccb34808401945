"""Simple-8b: several unsigned integers in one 64-bit word, in blocks that decode at once.

The top four bits of a word are a selector, which says how many ids of how many bits
the other 60 bits hold. A word takes as many ids as fit. Selector 15 is an escape: the
next word is one id of more than 60 bits as it is. Every block of ``BLOCK`` ids starts
with a word of its own, and the place of that word is stored, so all blocks can be
decoded side by side.
"""

from __future__ import annotations

import numpy as np

BLOCK = 128
# Fixed values of the format: ids per word and bits per id, by selector.
COUNTS = np.array([120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 64])
ESCAPE = 15


#: Room behind a block for the unused fields of its last word.
ROOM = BLOCK + int(COUNTS.max())


LIMITS = np.array([1 << int(b) for b in BITS[:-1]], dtype=np.uint64)
_SHORT = np.searchsorted(LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Index of the narrowest field, in order of selectors, that holds each id."""
    if ids.max() < len(_SHORT):
        return _SHORT[ids.astype(np.uint16)]
    return np.searchsorted(LIMITS, ids, side="right").astype(np.uint8)


def _in_rows(values: np.ndarray) -> np.ndarray:
    """One row for each block, zeros behind its values."""
    blocks = -(-len(values) // BLOCK)
    rows = np.zeros((blocks, ROOM), dtype=values.dtype)
    full = len(values) // BLOCK
    rows[:full, :BLOCK] = values[: full * BLOCK].reshape(full, BLOCK)
    if blocks > full:
        rows[full, : len(values) - full * BLOCK] = values[full * BLOCK :]
    return rows.reshape(-1)


def _best_selector(width: np.ndarray) -> np.ndarray:
    """For every place, the selector of the word that would start there.

    A word of more and narrower fields fits only where the next wider one does, so each
    step looks at the places that are left. Places behind a block count as zeros.
    """
    rows = width.reshape(-1, ROOM)
    # Every place fits the word whose fields hold the widest id.
    widest = min(int(width.max()), ESCAPE)
    best = np.full(rows.shape, widest, dtype=np.uint8)
    span = int(COUNTS[widest])
    most = rows[:, :BLOCK].copy()
    for k in range(1, span):
        np.maximum(most, rows[:, k : k + BLOCK], out=most)
    left = (np.arange(len(rows), dtype=np.int32)[:, None] * ROOM + np.arange(BLOCK, dtype=np.int32)).reshape(-1)
    best, most = best.reshape(-1), most.reshape(-1)
    for selector in range(widest - 1, -1, -1):
        fits = most <= selector
        left, most = left[fits], most[fits]
        while span < COUNTS[selector]:
            np.maximum(most, width[left + span], out=most)
            span += 1
        fits = most <= selector
        left, most = left[fits], most[fits]
        if len(left) == 0:
            break
        best[left] = selector
    return best


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the index of the first word of each block."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    if len(ids) == 0:
        return np.zeros(0, dtype="<u8"), np.zeros(0, dtype="<u4")
    blocks = -(-len(ids) // BLOCK)
    rows, best = _in_rows(ids), _best_selector(_in_rows(_widths(ids)))
    first = np.arange(blocks) * ROOM
    ends = first + np.minimum(BLOCK, len(ids) - np.arange(blocks) * BLOCK)
    # All blocks step from word to word together.
    place, live, starts = first.copy(), np.arange(blocks), []
    while len(live):
        at = place[live]
        starts.append(at)
        place[live] = at + COUNTS[best[at]]
        live = live[place[live] < ends[live]]
    start = np.sort(np.concatenate(starts))
    selector = best[start]
    size = np.where(selector == ESCAPE, 2, 1)
    where = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), dtype=np.uint64)
    for s in range(len(COUNTS)):
        pick = np.flatnonzero(selector == s)
        if len(pick) == 0:
            continue
        word = np.full(len(pick), s << 60, dtype=np.uint64)
        if s == ESCAPE:
            words[where[pick] + 1] = rows[start[pick]]
        else:
            for k in range(int(COUNTS[s]) if BITS[s] else 0):
                word |= rows[start[pick] + k] << np.uint64(k * int(BITS[s]))
        words[where[pick]] = word
    return words.astype("<u8"), where[np.searchsorted(start, first)].astype("<u4")


def decode(words: np.ndarray, offsets: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids, as unsigned 64-bit integers."""
    if n_ids == 0:
        return np.zeros(0, dtype=np.uint64)
    words = words.astype(np.uint64)
    selector = (words >> np.uint64(60)).astype(np.uint8)
    head = np.arange(len(words))
    # The word behind an escape is data and may look like anything, so blocks with
    # escapes are walked from their first word.
    if (selector == ESCAPE).any():
        data, bounds = np.zeros(len(words) + 1, dtype=bool), np.append(offsets, len(words))
        for b in np.unique(np.searchsorted(offsets, np.flatnonzero(selector == ESCAPE), side="right") - 1):
            w = int(bounds[b])
            while w < bounds[b + 1]:
                data[w + 1] = selector[w] == ESCAPE
                w += 1 + int(selector[w] == ESCAPE)
        head = np.flatnonzero(~data[:-1])
    selector = selector[head]
    done = np.cumsum(COUNTS[selector]) - COUNTS[selector]
    opening = np.searchsorted(head, offsets)
    per_block = np.diff(np.append(opening, len(head)))
    block_shift = np.arange(len(offsets)) * ROOM - done[opening]
    place = done + np.repeat(block_shift, per_block)
    out = np.zeros(len(offsets) * ROOM, dtype=np.uint64)
    for s in range(len(COUNTS)):
        pick = np.flatnonzero(selector == s)
        if len(pick) == 0 or BITS[s] == 0:
            continue
        at = place[pick]
        if s == ESCAPE:
            out[at] = words[head[pick] + 1]
            continue
        word, field = words[head[pick]], np.uint64((1 << int(BITS[s])) - 1)
        for k in range(int(COUNTS[s])):
            out[at + k] = (word >> np.uint64(k * int(BITS[s]))) & field
    return out.reshape(-1, ROOM)[:, :BLOCK].reshape(-1)[:n_ids]
