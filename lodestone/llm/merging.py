"""Pair merging (BPE) over a segment tree, for many short words in lockstep and for one long word.

Every leaf of the tree is a byte position; it holds the rank of the pair that starts there, and an inner node
holds the leftmost minimum below it. A merge reads the root, joins two live neighbours and repairs the paths of
three leaves: logarithmic work, whatever the length of the word.
"""

from __future__ import annotations

import numpy as np

NONE = np.int64(1) << 40
INF = np.int64(1) << 62
#: Words of more symbols are merged one at a time.
LONGEST_BATCHED = 512
#: Tree cells of the words that are merged in lockstep.
CELLS = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left, right) -> rank in an open-addressing table; ``new[rank]`` is the merged symbol."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, new: np.ndarray):
        keys = (left.astype(np.int64) << 20) | right.astype(np.int64)
        self.bits = max(10, int(len(keys) * 8 - 1).bit_length()) if len(keys) else 10
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int64)
        self.new = new.astype(np.int64)
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            slots = at[todo]
            _, first = np.unique(slots, return_index=True)
            winner = first[self.keys[slots[first]] == -1]
            self.keys[slots[winner]] = keys[todo[winner]]
            self.ranks[slots[winner]] = rank[todo[winner]]
            left_over = np.ones(len(todo), bool)
            left_over[winner] = False
            todo = todo[left_over]
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
        self.plain = {int(k): int(r) for k, r in zip(keys, rank)}

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 20) | right
        at = self._home(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.ranks[at], NONE)
        todo = np.flatnonzero((seen != keys) & (seen != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            seen = self.keys[at[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (seen != -1)]
        return out


def merge_long(symbols: list[int], table: PairTable) -> list[int]:
    """Merge one word of any length."""
    n = len(symbols)
    size = 1 << max(1, (n - 1).bit_length())
    none = (int(NONE), 0)
    ranks, new = table.plain, table.new
    tree = [none] * (2 * size)
    sym, nxt, prv = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))

    def pair(i: int) -> tuple[int, int]:
        j = nxt[i]
        return (ranks.get(sym[i] << 20 | sym[j], int(NONE)), i) if j < n else none

    for i in range(n):
        tree[size + i] = pair(i)
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: tuple[int, int]) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            best = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == best:
                break
            tree[k] = best
            k >>= 1

    while tree[1][0] < NONE:
        rank, i = tree[1]
        j = nxt[i]
        sym[i], sym[j] = int(new[rank]), -1
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        put(j, none)
        put(i, pair(i))
        if prv[i] >= 0:
            put(prv[i], pair(prv[i]))
    return [s for s in sym if s >= 0]


def merge_block(sym: np.ndarray, table: PairTable) -> np.ndarray:
    """Merge the rows of ``sym`` (words, padded with -1) in lockstep; merged-away cells become -1."""
    words, size = sym.shape
    shift = np.int64(size.bit_length() - 1)
    place = np.arange(size, dtype=np.int64)
    count = (sym >= 0).sum(axis=1)
    nxt = np.where(place + 1 < count[:, None], place + 1, size).ravel()
    prv = np.broadcast_to(place - 1, sym.shape).ravel().copy()
    tree = np.full((words, 2 * size), INF, np.int64)
    rows, cols = np.nonzero(sym[:, 1:] >= 0)
    rank = table.find(sym[rows, cols], sym[rows, cols + 1])
    tree[rows, size + cols] = np.where(rank < NONE, (rank << shift) | cols, INF)
    level = size
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    flat, cells = sym.ravel(), tree.ravel()
    live = np.arange(words, dtype=np.int64)
    while True:
        root = cells[live * (2 * size) + 1]
        keep = root < INF
        live, root = live[keep], root[keep]
        if not len(live):
            return flat.reshape(words, size)
        base, top = live * size, live * (2 * size)
        i, rank = root & (size - 1), root >> shift
        j = nxt[base + i]
        after = nxt[base + j]
        merged = table.new[rank]
        flat[base + i] = merged
        flat[base + j] = -1
        nxt[base + i] = after
        cells[top + size + j] = INF
        cells[top + size + i] = INF
        some = np.flatnonzero(after < size)
        if len(some):
            prv[base[some] + after[some]] = i[some]
            rank = table.find(merged[some], flat[base[some] + after[some]])
            cells[top[some] + size + i[some]] = np.where(rank < NONE, (rank << shift) | i[some], INF)
        before = prv[base + i]
        some = np.flatnonzero(before >= 0)
        if len(some):
            rank = table.find(flat[base[some] + before[some]], merged[some])
            cells[top[some] + size + before[some]] = np.where(rank < NONE, (rank << shift) | before[some], INF)
        trees = np.concatenate([top, top, top[some]])
        node = np.concatenate([i, j, before[some]]) + size
        while size > 1 and node[0] > 1:
            node >>= 1
            twin = trees + 2 * node
            cells[trees + node] = np.minimum(cells[twin], cells[twin + 1])


def merge_words(flat: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge all words (their symbols concatenated) -> (symbols concatenated, lengths)."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
    out_len = np.zeros(len(lengths), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    size = 2
    low = 0
    while low < LONGEST_BATCHED:
        chosen = np.flatnonzero((lengths > low) & (lengths <= size))
        step = max(1, CELLS // size)
        for at in range(0, len(chosen), step):
            ids = chosen[at : at + step]
            grid = starts[ids][:, None] + np.arange(size)
            inside = np.arange(size) < lengths[ids][:, None]
            sym = np.where(inside, flat[np.minimum(grid, len(flat) - 1)], -1).astype(np.int64)
            sym = merge_block(sym, table)
            alive = sym >= 0
            out_len[ids] = alive.sum(axis=1)
            found.append((ids, sym[alive]))
        low, size = size, size * 2
    for i in np.flatnonzero(lengths > LONGEST_BATCHED):
        ids = np.array(merge_long(flat[starts[i] : starts[i] + lengths[i]].tolist(), table), np.int64)
        out_len[i] = len(ids)
        found.append((np.array([i]), ids))
    out_starts = np.concatenate([[0], np.cumsum(out_len)]).astype(np.int64)
    out = np.empty(out_starts[-1], np.int64)
    for ids, symbols in found:
        n = out_len[ids]
        within = np.arange(len(symbols)) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(out_starts[ids], n) + within] = symbols
    return out, out_len
