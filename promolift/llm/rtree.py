"""R-trees over vectors of group counts, joined under the overlap bound.

A set's elements are hashed into fine groups, of which a bitmap says which are in use; elements beyond the first in a
group are the set's surplus. Two sets share at most the number of fine groups that both use plus the smaller surplus,
since a group's smaller count beyond one is part of either surplus. Sixteen fine groups make a coarse group, a word of
the bitmap, whose count is the word's number of bits: these counts are the point. The sum over all coarse groups of the
smaller count, and again the smaller surplus, bounds the overlap as well, and a box of points is bounded by its largest
counts and surplus. A pair of boxes or points that stays below the overlap which a similarity asks for is left out with
everything in it, and so is a pair within one component.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np

LEAF = 24
BITS = 16


class Points(NamedTuple):
    """Sizes, labels and bitmaps (a row of words each) of points with equally many groups."""

    sizes: np.ndarray
    labels: np.ndarray
    bits: np.ndarray

    @property
    def surplus(self) -> np.ndarray:
        return self.sizes - np.bitwise_count(self.bits).sum(1, dtype=np.int64)


@dataclass
class Node:
    own: np.ndarray
    high: np.ndarray
    surplus: int
    least: int
    most: int
    label: int | None
    parts: tuple[Node, Node] | None
    all_meet: bool = False


def bitmap(hashes: np.ndarray, groups: int) -> np.ndarray:
    """Words of a set of 64-bit hashes; ``groups`` is a power of two."""
    used = np.zeros(groups * BITS, bool)
    group, fine = hashes & np.uint64(groups - 1), (hashes >> np.uint64(32)) & np.uint64(BITS - 1)
    used[(group * np.uint64(BITS) + fine).astype(np.int64)] = True
    return np.packbits(used, bitorder="little").view(np.uint16)


def folded(bits: np.ndarray, groups: int) -> np.ndarray:
    """The same sets with fewer groups, a power of two times fewer; group numbers are taken modulo ``groups``."""
    while bits.shape[1] > groups:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def enough(overlap: np.ndarray | int, n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray | bool:
    """Whether sizes and an overlap, or a bound of it, allow the similarity."""
    similar = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    return similar & ((100 + percent) * overlap >= percent * (n + m))


class _Side:
    """One side of a join: points, their counts and surplus, and which of them meet another point."""

    def __init__(self, points: Points):
        self.points = points
        self.counts = np.bitwise_count(points.bits)
        self.surplus = points.surplus
        self.meets = np.zeros(len(points.sizes), bool)

    def tree(self) -> Node:
        return self._build(np.arange(len(self.meets)))

    def _build(self, own: np.ndarray) -> Node:
        """Bulk load: split at the median of the widest group until a leaf's worth is left."""
        parts = None
        counts, sizes, labels = self.counts[own], self.points.sizes[own], self.points.labels[own]
        high = counts.max(0)
        if len(own) > LEAF:
            spread = high - counts.min(0)
            axis = int(spread.argmax())
            order = own[np.argsort(counts[:, axis] if spread[axis] else sizes, kind="stable")]
            middle = len(order) // 2
            parts = (self._build(order[:middle]), self._build(order[middle:]))
        label = int(labels[0]) if (labels == labels[0]).all() else None
        surplus = int(self.surplus[own].max())
        return Node(own, high, surplus, int(sizes.min()), int(sizes.max()), label, parts)

    def all_meet(self, node: Node) -> bool:
        node.all_meet = node.all_meet or bool(self.meets[node.own].all())
        return node.all_meet


def _may_meet(a: Node, b: Node, percent: int) -> bool:
    if a.label is not None and a.label == b.label:
        return False
    if 100 * a.most < percent * b.least or 100 * b.most < percent * a.least:
        return False
    bound = int(np.minimum(a.high, b.high).sum(dtype=np.int64)) + min(a.surplus, b.surplus)
    return (100 + percent) * bound >= percent * (a.least + b.least)


def meeting(left: Points, right: Points | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which points of each side have a partner with another label that the bounds allow, on the other side or, where
    ``right`` is None, on their own. Both sides have the same groups. Boxes whose points all have one already are not
    looked at again, so a dense group takes little more time than a scattered one."""
    one = _Side(left)
    two = one if right is None else _Side(right)
    root = one.tree()
    stack = [(root, root if right is None else two.tree())]
    while stack:
        a, b = stack.pop()
        if (one.all_meet(a) and two.all_meet(b)) or not _may_meet(a, b, percent):
            continue
        if a.parts is None and b.parts is None:
            _leaves_meet(one, two, a.own, b.own, percent)
        elif a is b:
            first, second = a.parts
            stack += [(first, second), (second, second), (first, first)]
        elif b.parts is None or (a.parts is not None and len(a.own) >= len(b.own)):
            stack += [(part, b) for part in a.parts]
        else:
            stack += [(a, part) for part in b.parts]
    return one.meets, two.meets


def _leaves_meet(one: _Side, two: _Side, a: np.ndarray, b: np.ndarray, percent: int) -> None:
    n, m = one.points.sizes[a][:, None], two.points.sizes[b][None, :]
    spare = np.minimum(one.surplus[a][:, None], two.surplus[b][None, :])
    fits = one.points.labels[a][:, None] != two.points.labels[b][None, :]
    i, j = np.nonzero(fits & enough(np.minimum(n, m), n, m, percent))
    i, j, spare = a[i], b[j], spare[i, j]
    n, m = one.points.sizes[i], two.points.sizes[j]
    coarse = np.minimum(one.counts[i], two.counts[j]).sum(1, dtype=np.int64) + spare
    kept = enough(coarse, n, m, percent)
    i, j, spare, n, m = i[kept], j[kept], spare[kept], n[kept], m[kept]
    fine = np.bitwise_count(one.points.bits[i] & two.points.bits[j]).sum(1, dtype=np.int64) + spare
    kept = enough(fine, n, m, percent)
    one.meets[i[kept]] = True
    two.meets[j[kept]] = True
