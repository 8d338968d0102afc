"""Suffix arrays in numpy, and the windows of a text that occur again.

Everything here works on bytes and knows nothing of Spark.
"""

import numpy as np

#: Bytes whose suffixes are sorted at once.
CHUNK_BYTES = 1 << 19
WINDOW_BITS = 31
MIX = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xD6E8FEB86659FD93)


def packed(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; zeros follow the end."""
    value = np.r_[data, np.zeros(7, np.uint8)].astype(np.uint64)
    for step in (1, 2, 4):
        value = (value[:-step] << np.uint64(8 * step)) | value[step:]
    return value


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their suffixes, by Larsson-Sadakane refinement to ``depth`` bytes or more.

    Suffixes are sorted by eight bytes first. Each round then sorts the members of every group
    that is still tied by the group of the suffix that follows the known bytes, which doubles
    these; groups of one are left alone.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    first = packed(data)
    order = n - 1 - np.argsort(first[::-1], kind="stable")  # of equal ones the shorter suffix first
    new = np.r_[True, first[order][1:] != first[order][:-1]]
    del first
    rank = np.zeros(n + 1, np.int64)  # 1 + the place of a group's first member; 0 beyond the end
    leader = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = leader + 1
    known = 8
    while known < depth:
        tied = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(tied):
            break
        members = order[tied]
        group = rank[members]
        after = rank[np.minimum(members + known, n)]
        by = np.argsort((group << 32) | after, kind="stable")
        members, group, after = members[by], group[by], after[by]
        order[tied] = members
        split = np.r_[True, (group[1:] != group[:-1]) | (after[1:] != after[:-1])]
        new[tied] = split
        rank[members] = np.maximum.accumulate(np.where(split, tied, 0)) + 1
        known *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, enough: int | None = None, parts: np.ndarray | None = None) -> np.ndarray:
    """For each place of the suffix array, the bytes shared with the suffix before it (Kasai).

    Numbers of ``enough`` or more are only known to be at least that. ``parts`` are places where
    comparing starts afresh, so that long periodic texts are not followed from end to end.

    Let ``before`` be the suffix that precedes a suffix in the array. Where the suffix and its
    ``before`` both follow, by one byte, those of the place on the left, one byte less is shared
    than there. Only the other places are compared, eight bytes at a time.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    fresh = np.r_[True, before[1:] != before[:-1] + 1] | (before < 0)
    if parts is not None:
        fresh[parts] = True
    words = packed(data)
    starts = np.flatnonzero(fresh)
    upto = np.r_[starts[1:], n] - starts + (n if enough is None else enough)  # what the places after each start need
    starts, upto = starts[before[starts] >= 0], upto[before[starts] >= 0]
    length = np.zeros(n, np.int64)
    active, other, done = starts, before[starts], 0
    while len(active):
        a, b = active + done, other + done
        room = n - np.maximum(a, b)
        differ = np.where(room > 0, words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)], np.uint64(1 << 63))
        # Bytes that agree: the leading zero bytes of the difference, none beyond the end.
        agree = np.full(len(active), 8, np.int64)
        for k in range(7, -1, -1):
            agree[(differ >> np.uint64(8 * (7 - k))) & np.uint64(255) != 0] = k
        agree = np.minimum(agree, np.maximum(room, 0))
        length[active] += agree
        done += 8
        going = (agree == 8) & (upto > done)
        active, other, upto = active[going], other[going], upto[going]
    source = np.maximum.accumulate(np.where(fresh, place, 0))
    shared = np.where(before >= 0, np.maximum(length[source] - (place - source), 0), 0)
    return shared[order]


def seed_bytes(length: int) -> int:
    """Bytes of a seed, so that a window of ``length`` bytes has at most WINDOW_BITS of them."""
    return length - WINDOW_BITS + 1 if length >= 40 else (length + 1) // 2


def run_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each place on, by doubling."""
    part = (data.astype(np.uint64) + np.uint64(1)) * SPREAD
    part ^= part >> np.uint64(32)
    total, have, width = None, 0, 1
    while True:
        if size & width:
            if total is None:
                total = part
            else:
                m = len(part) - have
                total = total[:m] * MIX + part[have:]
            have += width
        width *= 2
        if width > size:
            break
        half = width // 2
        part = part[:-half] * (MIX ^ np.uint64(width)) + part[half:]
        part ^= part >> np.uint64(29)
    total = total * SPREAD
    total ^= total >> np.uint64(31)
    return total


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of ``width`` values from each place on."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


class Contexts:
    """The windows of many texts, gathered by seed.

    The seed of a window is the run of bytes in it with the smallest hash. A context is a run of
    adjoining windows with one seed, at most WINDOW_BITS of them. Equal windows have equal seeds, so windows
    need only be compared with those of contexts whose seed has the same hash.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, block: int = 1 << 17):
        self.data, self.length = data, length
        size = seed_bytes(length)
        width = length - size + 1
        starts, counts, keys, seeds = [], [], [], []
        last = offsets[1:]
        for low in range(0, max(len(data) - length + 1, 0), block):
            part = data[low : low + block + length - 1]
            hashes = run_hashes(part, size)
            spot = np.arange(len(hashes), dtype=np.uint64)
            smallest = sliding_min((hashes & np.uint64(0xFFFFFFFFFF000000)) | spot, width)
            seed = (smallest & np.uint64(0xFFFFFF)).astype(np.int32)
            # Windows that run over the end of a text belong to none.
            ends = last[np.searchsorted(last, low) : np.searchsorted(last, low + len(part), "right")] - low
            across = np.zeros(len(seed) + 1, np.int32)
            np.add.at(across, np.clip(ends - length + 1, 0, len(seed)), 1)
            np.add.at(across, np.clip(ends, 0, len(seed)), -1)
            seed[np.cumsum(across[:-1]) > 0] = -1
            edge = np.flatnonzero(np.r_[True, seed[1:] != seed[:-1]])
            count = np.diff(np.r_[edge, len(seed)])
            good = seed[edge] >= 0
            edge, count = edge[good], count[good]
            starts.append(edge + low)
            counts.append(count)
            keys.append(hashes[seed[edge]])
            seeds.append(seed[edge] + np.int64(low))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.start, self.windows, self.key = join(starts, np.int64), join(counts, np.int64), join(keys, np.uint64)
        self.seed = join(seeds, np.int64)

    def text_hashes(self) -> np.ndarray:
        """A 64-bit hash of each context's bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        # Prefix sums of byte values times powers of an odd step; a run's sum is brought to a common power.
        out = np.zeros(len(self.start), np.uint64)
        sizes = self.windows + self.length - 1
        for low in range(0, len(self.start), 40_000):
            a, s = self.start[low : low + 40_000], sizes[low : low + 40_000]
            base = int(a[0])
            part = self.data[base : int((a + s).max())]
            powers = np.full(len(part) + 1, MIX, np.uint64)
            powers[0] = 1
            powers = np.multiply.accumulate(powers)
            value = (part.astype(np.uint64) + np.uint64(1)) * SPREAD
            value ^= value >> np.uint64(29)
            total = np.r_[np.uint64(0), np.cumsum(value * powers[:-1], dtype=np.uint64)]
            a = a - base
            total = (total[a + s] - total[a]) * _inverse_power(a)
            total ^= total >> np.uint64(31)
            out[low : low + 40_000] = total * SPREAD + s.astype(np.uint64)
        return out


_STEP_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _inverse_power(exponents: np.ndarray) -> np.ndarray:
    """The inverse of MIX to each of ascending exponents, modulo 2**64."""
    powers = np.full(int(exponents.max()) + 1, _STEP_INVERSE, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)[exponents]


def cut_out(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The given runs of bytes one after another."""
    total = int(size.sum())
    ends = np.cumsum(size)
    return data[np.arange(total) + np.repeat(start - (ends - size), size)]


def hash_from(data: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """A hash of ``size`` bytes from each start."""
    total = np.zeros(len(start), np.uint64)
    for k in range(size):
        total = (total ^ data[start + k]) * np.uint64(0x100000001B3)
        total ^= total >> np.uint64(33)
    return total


def may_repeat(
    data: np.ndarray, start: np.ndarray, windows: np.ndarray, key: np.ndarray, owner: np.ndarray, length: int, seed: np.ndarray
) -> np.ndarray:
    """Contexts that another owner's context of the same key may share a window with.

    Equal windows have their seed at the same place, so they agree in the half of the other
    bytes that stands before the seed, or in the half after it.
    """
    size = seed_bytes(length)
    half = (length - size) // 2
    result = np.zeros(len(start), bool)
    for room, at in ((seed - start, seed - half), (start + windows + length - 1 - seed - size, seed + size)):
        able = np.flatnonzero(room >= half)
        side = hash_from(data, at[able], half) ^ key[able].astype(np.uint64) * MIX
        order = np.argsort(side, kind="stable")
        edge = np.flatnonzero(np.r_[True, side[order][1:] != side[order][:-1]]) if len(order) else order
        if not len(edge):
            continue
        own = owner[able][order]
        several = np.minimum.reduceat(own, edge) != np.maximum.reduceat(own, edge)
        result[able[order[np.repeat(several, np.diff(np.r_[edge, len(order)]))]]] = True
    return result


def equal_contexts(data: np.ndarray, start: np.ndarray, windows: np.ndarray, key: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each context one of the same key and bytes, of the smallest owner that has it; itself if there is no other."""
    size = windows + length - 1
    side = hash_from(data, start, length) ^ key.astype(np.uint64) * MIX ^ hash_from(data, start + size - length, length) * SPREAD
    by = np.lexsort((owner, size, side))
    same = (side[by][1:] == side[by][:-1]) & (size[by][1:] == size[by][:-1])
    first = np.flatnonzero(np.r_[True, ~same]) if len(by) else by
    like = np.arange(len(start))
    like[by] = by[np.repeat(first, np.diff(np.r_[first, len(by)]))]
    # The hashes see the first and last bytes only, and may agree by accident: all bytes decide.
    others = np.flatnonzero(like != np.arange(len(start)))
    for low in range(0, len(others), 10_000):
        own = others[low : low + 10_000]
        span = size[own]
        unlike = cut_out(data, start[own], span) != cut_out(data, start[like[own]], span)
        wrong = np.add.reduceat(unlike, np.cumsum(span) - span) > 0
        like[own[wrong | (key[own] != key[like[own]])]] = own[wrong | (key[own] != key[like[own]])]
    return like


def covered_windows(
    data: np.ndarray, start: np.ndarray, windows: np.ndarray, key: np.ndarray, owner: np.ndarray, length: int, seed: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Windows of contexts that also stand in a context of a smaller owner: (context, window in it).

    Of contexts with the same key and bytes one of the smallest owner stands for all: a line that a
    whole shard repeats is one context. The others go by key in chunks of bounded size, each with
    its own suffix array; one key with more distinct text than a chunk makes a larger chunk.
    ``seed`` is where each context's seed stands.
    """
    found_context, found_window = [], []
    order = np.flatnonzero(may_repeat(data, start, windows, key, owner, length, seed))
    like = np.arange(len(start))
    like[order] = order[equal_contexts(data, start[order], windows[order], key[order], owner[order], length)]
    copies = order[like[order] != order]
    order = order[like[order] == order]
    order = order[np.argsort(key[order], kind="stable")]
    padded = np.r_[data, np.uint8(0)]
    size = windows[order] + length  # a zero byte parts contexts
    ends = np.cumsum(size)
    group_end = np.flatnonzero(np.r_[key[order][1:] != key[order][:-1], True]) if len(order) else order
    low = 0
    while low < len(order):
        limit = (ends[low - 1] if low else 0) + CHUNK_BYTES
        fits = group_end[(group_end >= low) & (ends[group_end] <= limit)]
        high = int(fits[-1] if len(fits) else group_end[group_end >= low][0]) + 1
        chosen = order[low:high]
        low = high
        span = windows[chosen] + length
        text = cut_out(padded, start[chosen], span)
        own_end = np.cumsum(span)
        text[own_end - 1] = 0
        place = own_end - span
        sorted_places = suffix_array(text, length)
        shared = common_prefixes(text, sorted_places, length, place)
        which = np.repeat(np.arange(len(chosen)), span)
        inside = np.arange(len(text)) - place[which]
        holder = np.where(inside < windows[chosen][which], owner[chosen][which], np.iinfo(np.int64).max)
        run = np.cumsum(np.r_[False, shared[1:] < length]) if len(text) else np.zeros(0, np.int64)
        held = holder[sorted_places]
        # Merge: the owners of each run of equal windows in order, and by binary search its first.
        by = np.lexsort((held, run))
        first = np.searchsorted(run[by], run)
        hit = sorted_places[(held < np.iinfo(np.int64).max) & (held[by][first] < held)]
        found_context.append(chosen[which[hit]])
        found_window.append(inside[hit])
    if not found_context:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    context, window = np.concatenate(found_context), np.concatenate(found_window)
    # A copy of a larger owner is covered whole; a copy of the same owner where the one it is like is covered.
    later = copies[owner[copies] > owner[like[copies]]]
    n = windows[later]
    all_windows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    own = copies[owner[copies] == owner[like[copies]]]
    by = np.argsort(context, kind="stable")
    low, high = (np.searchsorted(context[by], like[own], side) for side in ("left", "right"))
    taken = np.repeat(low, high - low) + np.arange(int((high - low).sum())) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
    return (
        np.concatenate([context, np.repeat(later, n), np.repeat(own, high - low)]),
        np.concatenate([window, all_windows, window[by][taken]]),
    )
