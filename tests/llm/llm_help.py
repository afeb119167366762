from __future__ import annotations


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.root(a)] = self.root(b)


def components(nodes, links):
    """The least node that links reach, for every node."""
    u = Union()
    for a, b in links:
        u.join(a, b)
    least = {}
    for n in nodes:
        r = u.root(n)
        least[r] = min(least.get(r, n), n)
    return {n: least[u.root(n)] for n in nodes}
