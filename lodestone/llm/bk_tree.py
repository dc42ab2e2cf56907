"""BK-trees of fingerprints: children keyed by the integer Hamming distance to their parent."""

from __future__ import annotations


class BKTree:
    """A BK-tree of distinct fingerprints, of any number of bits, whose entries can be taken out."""

    def __init__(self, values: list[int]):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        self.parent = [-1] * len(values)
        self.alive = [True] * len(values)
        self.below = [1] * len(values)  # entries still in the subtree
        for i in range(1, len(values)):
            at, v = 0, values[i]
            while True:
                self.below[at] += 1
                d = (v ^ values[at]).bit_count()
                child = self.children[at].get(d)
                if child is None:
                    self.children[at][d] = i
                    self.parent[i] = at
                    break
                at = child

    def remove(self, i: int) -> None:
        self.alive[i] = False
        while i >= 0:
            self.below[i] -= 1
            i = self.parent[i]

    def within(self, value: int, radius: int) -> list[int]:
        """Entries still in the tree at distance ``radius`` or less."""
        found, stack = [], [0] if self.values and self.below[0] else []
        values, children, below = self.values, self.children, self.below
        while stack:
            at = stack.pop()
            d = (value ^ values[at]).bit_count()
            if d <= radius and self.alive[at]:
                found.append(at)
            for edge, child in children[at].items():
                if d - radius <= edge <= d + radius and below[child]:
                    stack.append(child)
        return found


def forest(values: list[int], radius: int, sizes: list[int] | None = None, ratio: float = 0.0) -> list[tuple[int, int]]:
    """Links (i, j) that span the groups which links within the radius form among distinct values.

    Where ``sizes`` are given, links are those of entries whose sizes have this ratio or more.
    """
    tree, links = BKTree(values), []
    for root in range(len(values)):
        if not tree.alive[root]:
            continue
        tree.remove(root)
        todo = [root]
        while todo:
            i = todo.pop()
            for j in tree.within(values[i], radius):
                if sizes and min(sizes[i], sizes[j]) < ratio * max(sizes[i], sizes[j]):
                    continue
                tree.remove(j)
                links.append((root, j))
                todo.append(j)
    return links
