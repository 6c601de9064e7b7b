"""Bin completion on the counts of sizes.

Pieces of one size are alike, so the input is one count per size, whatever the number of
pieces, and the result is a list of fillings with how often each is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

Filling = tuple[int, ...]  # sizes, largest first
# Steps of the whole search, whatever the input. The best packing found so far is the answer when they are used up;
# no piece is ever left out.
STEPS = 3000


def best_fit(counts: np.ndarray, room: int) -> list[tuple[Filling, int]]:
    """Best fit by decreasing size, many equal pieces at a time."""
    spare: dict[int, dict[Filling, int]] = {}

    def put(left: int, filling: Filling, times: int) -> None:
        held = spare.setdefault(left, {})
        held[filling] = held.get(filling, 0) + times

    for size in range(room, 0, -1):
        n = int(counts[size])
        while n:
            left = min((s for s in spare if s >= size), default=0)
            if left:
                filling, times = spare[left].popitem()
                used = min(n, times)
                if times > used:
                    put(left, filling, times - used)
                if not spare[left]:
                    del spare[left]
                put(left - size, (*filling, size), used)
                n -= used
            else:
                each = room // size
                if n >= each:
                    put(room - size * each, (size,) * each, n // each)
                if n % each:
                    put(room - size * (n % each), (size,) * (n % each), 1)
                n = 0
    return [(filling, times) for held in spare.values() for filling, times in held.items()]


def _reachable(sizes: list[int], most: list[int], room: int) -> list[int]:
    """For every place in ``sizes``, the sums up to ``room`` that the sizes from there on can have, as bits."""
    mask = (1 << (room + 1)) - 1
    sums = [1] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        now, n, times = sums[i + 1], most[i], 1
        while n > 0:
            times = min(times, n)
            now |= now << (sizes[i] * times) & mask
            n, times = n - times, times * 2
        sums[i] = now
    return sums


def completions(counts: np.ndarray, room: int, most_waste: int | None = None) -> Iterator[Filling]:
    """All undominated fillings of ``room`` with the pieces that are left, least waste first, found as they are asked for.

    A filling is dominated if a piece left over would still fit beside it, or in the place of a smaller
    one of its pieces. One piece that fills the room dominates every other filling. Fillings of any number of
    pieces are given; those of equal waste come largest piece first. Only ``most_waste`` ends the list early.
    """
    if room > 0 and counts[room] > 0:
        yield (room,)
        return
    sizes = [int(s) for s in np.flatnonzero(counts[:max(0, room) + 1])[::-1] if s > 0]
    most = [min(int(counts[s]), room // s) for s in sizes]
    sums = _reachable(sizes, most, max(0, room))
    held = {s: int(counts[s]) for s in sizes}

    def exact(i: int, total: int) -> Iterator[list[tuple[int, int]]]:
        if total == 0:
            yield []
            return
        for j in range(i, len(sizes)):
            if not sums[j] >> total & 1:
                return
            for times in range(min(most[j], total // sizes[j]), 0, -1):
                rest = total - times * sizes[j]
                if sums[j + 1] >> rest & 1:
                    for more in exact(j + 1, rest):
                        yield [(sizes[j], times), *more]

    def dominated(used: dict[int, int], waste: int) -> bool:
        spare = [s for s in sizes if held[s] > used.get(s, 0)]
        return any(s <= waste or any(0 < s - own <= waste for own in used) for s in spare)

    last = max(0, room) if most_waste is None else min(max(0, room), most_waste)
    for waste in range(last + 1):
        if sums[0] >> (room - waste) & 1:
            for chosen in exact(0, room - waste):
                if not waste or not dominated(dict(chosen), waste):
                    yield tuple(s for s, times in chosen for _ in range(times))


def least_bins(counts: np.ndarray, room: int) -> int:
    """Bins that no packing can do without.

    For each small size ``a``: pieces over ``room - a`` stand alone among pieces of at least ``a``,
    other pieces over half need a bin each, and what their bins cannot take of the pieces from ``a`` to
    half needs more bins.
    """
    sizes = np.arange(room + 1)
    n, volume = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * sizes)])
    half = room // 2
    least = -(-int(volume[-1]) // room)
    for a in range(0, half + 1):
        alone, halves = int(n[-1] - n[room - a + 1]), int(n[room - a + 1] - n[half + 1])
        spare = halves * room - int(volume[room - a + 1] - volume[half + 1])
        small = int(volume[half + 1] - volume[a])
        least = max(least, alone + halves + max(0, -(-(small - spare) // room)))
    return least


def pack_counts(counts: np.ndarray, room: int, steps: int = STEPS) -> list[tuple[Filling, int]]:
    """Fillings of at most ``room`` and how often each is used, in as few bins as found.

    ``counts[s]`` pieces have size s (1..room). Depth-first: the largest piece left is
    completed in each undominated way, least waste first, as often as the counts allow and then once; a branch ends
    when its waste exceeds what a packing better than the best one could have. Best fit gives the first
    best one, and the search ends at ``least_bins``, when nothing is left to try, or after ``steps``.
    """
    counts = np.asarray(counts, np.int64)
    total = int((counts * np.arange(len(counts))).sum())
    if total == 0:
        return []
    best = best_fit(counts, room)
    n_best = sum(times for _, times in best)
    least = least_bins(counts, room)
    left = counts.copy()
    path: list[tuple[Filling, int]] = []
    waste = 0

    def spare() -> int:
        """Waste that a packing better than the best one may still add."""
        return (n_best - 1) * room - total - waste

    def ways() -> Iterator[tuple[Filling, int]]:
        top = int(np.flatnonzero(left)[-1])
        now = left.copy()
        now[top] -= 1
        for rest in completions(now, room - top, spare()):
            filling = (top, *rest)
            need = np.bincount(filling)
            times = int((left[:len(need)][need > 0] // need[need > 0]).min())
            yield filling, times
            if times > 1:
                yield filling, 1

    def apply(filling: Filling, times: int) -> None:
        for size in filling:
            left[size] -= times

    stack = [ways()] if spare() >= 0 else []
    while stack and steps > 0 and n_best > least:
        steps -= 1
        way = next(stack[-1], None)
        filling, times = way or ((), 0)
        each = room - sum(filling)
        # Ways come with growing waste: none that follows one too wasteful can be better.
        if way is None or each > spare():
            stack.pop()
            if path:
                filling, times = path.pop()
                apply(filling, -times)
                waste -= (room - sum(filling)) * times
            continue
        if each * times > spare():
            continue
        apply(filling, times)
        path.append((filling, times))
        waste += each * times
        if left.any():
            stack.append(ways())
            continue
        n = sum(t for _, t in path)
        if n < n_best:
            best, n_best = list(path), n
        path.pop()
        apply(filling, -times)
        waste -= each * times
    return best
