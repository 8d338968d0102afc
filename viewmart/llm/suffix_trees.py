"""Runs (maximal repetitions) of sequences of small integers, from suffix trees.

Ukkonen trees of the sequence and of its reversal answer, through the lowest common ancestor of two
leaves on an Euler tour, how far two places agree to the right and to the left. Every run has a
Lyndon root: the longest Lyndon word at some place, under the order of the symbols or under its
reverse. So each place gives two candidate periods, and each candidate is extended both ways.
"""

import numpy as np


class SuffixTree:
    """Of a sequence whose last symbol occurs nowhere else; symbols are 0 .. n_symbols - 1."""

    def __init__(self, sequence: list[int], n_symbols: int):
        self.size = len(sequence)
        self._grow(sequence, n_symbols)

    def _grow(self, s: list[int], k: int) -> None:
        """Ukkonen: node 0 is the root; an edge is known by node * k + first symbol."""
        n = len(s)
        begin, end, link, suffix = [0], [0], [0], [-1]
        go: dict[int, int] = {}
        node = edge = length = pending = 0
        for i, c in enumerate(s):
            waiting = 0  # an inner node made in this phase that has no suffix link yet
            pending += 1
            while pending:
                if not length:
                    edge = i
                key = node * k + s[edge]
                child = go.get(key)
                if child is None:
                    go[key] = len(begin)
                    begin.append(i), end.append(n), link.append(0), suffix.append(i - pending + 1)
                    if waiting:
                        link[waiting] = node
                    waiting = 0
                else:
                    at = begin[child]
                    span = end[child] - at
                    if length >= span:
                        edge, length, node = edge + span, length - span, child
                        continue
                    if s[at + length] == c:
                        length += 1
                        if waiting:
                            link[waiting] = node
                        break
                    inner = len(begin)
                    begin.append(at), end.append(at + length), link.append(0), suffix.append(-1)
                    go[key] = inner
                    begin[child] = at + length
                    go[inner * k + s[at + length]] = child
                    go[inner * k + c] = len(begin)
                    begin.append(i), end.append(n), link.append(0), suffix.append(i - pending + 1)
                    if waiting:
                        link[waiting] = inner
                    waiting = inner
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - pending + 1
        keys = np.fromiter(go.keys(), np.int64, len(go))
        kids = np.fromiter(go.values(), np.int64, len(go))
        order = np.argsort(keys)
        self.kids = kids[order]
        self.first_kid = np.searchsorted(keys[order], np.arange(len(begin) + 1) * k)
        self.symbol = keys[order] % k
        self.span = np.array(end) - np.array(begin)
        self.suffix = suffix

    def tour(self) -> tuple[np.ndarray, np.ndarray]:
        """String depths along the Euler tour, and the place of each suffix's leaf in it."""
        kids, suffix, span = self.kids.tolist(), self.suffix, self.span.tolist()
        nxt, stop = self.first_kid[:-1].tolist(), self.first_kid[1:].tolist()
        depths, place = [0], [0] * self.size
        path, depth = [0], [0]
        while path:
            node = path[-1]
            at = nxt[node]
            if at == stop[node]:
                path.pop(), depth.pop()
                if path:
                    depths.append(depth[-1])
                continue
            nxt[node] = at + 1
            child, here = kids[at], depth[-1]
            below = here + span[child]
            depths.append(below)
            if suffix[child] >= 0:
                place[suffix[child]] = len(depths) - 1
                depths.append(here)
            else:
                path.append(child), depth.append(below)
        return np.array(depths, np.int32), np.array(place, np.int64)

    def ranks(self, n_ends: int, reverse: bool) -> list[int]:
        """The rank of each suffix; the symbols below ``n_ends`` stay first when the others are reversed."""
        kids, suffix, symbol = self.kids.tolist(), self.suffix, self.symbol
        bounds = self.first_kid.tolist()
        if reverse:
            parent = np.repeat(np.arange(len(bounds) - 1), np.diff(self.first_kid))
            kids = self.kids[np.lexsort((np.where(symbol < n_ends, symbol - n_ends, -symbol + symbol.max(initial=0)), parent))].tolist()
        rank, n = [0] * self.size, 0
        # The stack yields the last pushed first.
        stack = [0]
        while stack:
            node = stack.pop()
            at = suffix[node]
            if at >= 0:
                rank[at] = n
                n += 1
            else:
                stack += kids[bounds[node] : bounds[node + 1]][::-1]
        return rank


class Agreement:
    """How many symbols from two places on agree: depth of the lowest common ancestor, in constant time."""

    def __init__(self, tree: SuffixTree):
        depths, self.place = tree.tour()
        self.table = [depths]
        width = 1
        while 2 * width <= len(depths):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of arrays of places, each pair distinct."""
        left, right = np.minimum(self.place[a], self.place[b]), np.maximum(self.place[a], self.place[b])
        level = np.frexp((right - left + 1).astype(np.float64))[1] - 1
        found = np.empty(len(left), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            row = self.table[k]
            found[at] = np.minimum(row[left[at]], row[right[at] + 1 - (1 << k)])
        return found


def lyndon_lengths(rank: list[int]) -> np.ndarray:
    """Length of the longest Lyndon word at each place: the distance to the next smaller suffix."""
    n = len(rank)
    length, later = [0] * n, [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        j, own = i + 1, rank[i]
        while j < n and rank[j] > own:
            j = later[j]
        later[i] = j
        length[i] = j - i
    return np.array(length)


def runs_of(sequences: list[np.ndarray], min_length: int, min_exponent: int) -> np.ndarray:
    """All runs as rows (sequence, start, length, period), sorted; at least two periods long.

    A run has the smallest period of its stretch, is at least ``max(min_length, min_exponent *
    period)`` long, and no neighbour in its sequence keeps the period.
    """
    if min_exponent < 2:
        raise ValueError("a run is at least two periods long")
    none = np.zeros((0, 4), np.int64)
    sizes = np.array([len(s) for s in sequences], np.int64)
    if not sizes.sum():
        return none
    # An end of its own stands before, between and after the sequences, so nothing agrees across.
    n_ends = len(sequences) + 1
    distinct, codes = np.unique(np.concatenate(sequences), return_inverse=True)
    starts = np.cumsum(sizes + 1) - sizes  # the first sequence begins at 1
    whole = np.empty(int(sizes.sum()) + n_ends, np.int64)
    inside = np.ones(len(whole), bool)
    inside[np.r_[0, starts + sizes]] = False
    whole[inside] = codes + n_ends
    whole[~inside] = np.arange(n_ends)
    n_symbols, last = n_ends + len(distinct), len(whole) - 1

    tree = SuffixTree(whole.tolist(), n_symbols)
    right = Agreement(tree)
    ranks = [tree.ranks(n_ends, reverse) for reverse in (False, True)]
    del tree
    left = Agreement(SuffixTree(whole[::-1].tolist(), n_symbols))

    found = [none]
    places = np.flatnonzero(inside)
    for rank in ranks:
        period = lyndon_lengths(rank)[places]
        i, j = places, places + period
        before = left(last - (i - 1), last - (j - 1))
        after = right(i, j)
        length = before + period + after
        long = length >= np.maximum(min_length, min_exponent * period)
        found.append(np.stack([i - before, length, period], 1)[long])
        del before, after, length
    rows = np.unique(np.concatenate([f.reshape(-1, 3) for f in found[1:]]), axis=0)
    owner = np.searchsorted(starts, rows[:, 0], "right") - 1
    out = np.column_stack([owner, rows[:, 0] - starts[owner], rows[:, 1], rows[:, 2]])
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]
