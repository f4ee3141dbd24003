"""Bit-parallel edit distances: one Python integer holds a column of the alignment."""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence


def masks(pattern: Sequence[Hashable]) -> dict[Hashable, int]:
    out: dict[Hashable, int] = {}
    for k, c in enumerate(pattern):
        out[c] = out.get(c, 0) | (1 << k)
    return out


def banded_distance(a: Sequence[Hashable], b: Sequence[Hashable], most: int) -> int:
    """Edit distance of `a` and `b`, or most + 1 if it is larger. Looks only at cells at most `most`
    off the main diagonal; equal ends are cut off first, which changes no distance."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    i, n = 0, len(b)
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[len(a) - 1 - j] == b[n - 1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : n - j]
    if not len(b) or most == 0:
        return min(len(a), most + 1)
    most_here = min(most, len(a))
    found = _band(a, b, most_here)
    return found if found <= most_here else most + 1


def _band(a: Sequence[Hashable], b: Sequence[Hashable], k: int) -> int:
    """len(a) >= len(b); k <= len(a). The window of 2k + 1 rows moves down one row a column."""
    where, full, top = masks(a), (1 << (2 * k + 1)) - 1, 1 << (2 * k)
    plus, minus, cost, turn = (full << k) & full, 0, k, len(a) - k
    side, limit = 1 << (2 * k - 1), k + len(b) - turn
    for i, c in enumerate(b):
        m = where.get(c, 0)
        m = (m >> (i - k) if i >= k else m << (k - i)) & full
        d = ((((m & plus) + plus) ^ plus) | m | minus) & full
        hp, hn = (minus | ~(d | plus)) & full, d & plus
        if i < turn:
            cost += not d & top
        else:
            cost += bool(hp & side)
            cost -= bool(hn & side)
            side >>= 1
        if cost > limit:
            return k + 1
        d >>= 1
        plus, minus = (hn | ~(d | hp)) & full, d & hp
    return cost


def costs_inside(pattern: Sequence[Hashable], text: Sequence[Hashable]) -> Iterator[int]:
    """For each place of `text` the least edit distance of `pattern` to a part of it that ends there."""
    where, n = masks(pattern), len(pattern)
    full, last = (1 << n) - 1, 1 << (n - 1)
    plus, minus, cost = full, 0, n
    for c in text:
        m = where.get(c, 0)
        d = ((((m & plus) + plus) ^ plus) | m | minus) & full
        hp, hn = (minus | ~(d | plus)) & full, d & plus
        if hp & last:
            cost += 1
        elif hn & last:
            cost -= 1
        hp = (hp << 1) & full
        plus, minus = ((hn << 1) | ~(d | hp)) & full, hp & d
        yield cost


def best_inside(pattern: Sequence[Hashable], text: Sequence[Hashable]) -> tuple[int, int]:
    """Least edit distance of `pattern` to any part of `text`, and where the first such part ends."""
    best, end = len(pattern), 0
    for i, cost in enumerate(costs_inside(pattern, text)):
        if cost < best:
            best, end = cost, i + 1
    return best, end


def ends_inside(pattern: Sequence[Hashable], text: Sequence[Hashable], most: int) -> Iterator[tuple[int, int]]:
    """(edits, end) of parts within `most` edits of `pattern`: the first best end of each run of such ends, and again half a
    pattern after it where the run goes on."""
    found = None
    for i, cost in enumerate(costs_inside(pattern, text)):
        if found and (cost > most or i + 1 - found[1] > len(pattern) // 2):
            yield found
            found = None
        if cost <= most and (found is None or cost < found[0]):
            found = (cost, i + 1)
    if found:
        yield found
