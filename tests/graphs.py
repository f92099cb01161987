"""Small graphs and brute-force answers for the graph tests."""

from __future__ import annotations

import heapq
import random
from collections import defaultdict

from farness.graph import Graph


def frame(spark, n, edges, directed=False):
    weighted = bool(edges) and len(edges[0]) == 3
    schema = "src long, dst long" + ", weight long" * weighted
    return Graph(spark.range(n), spark.createDataFrame(edges, schema), directed)


def sums(n, edges, directed=False):
    """{id: (r, d)} by a shortest-path search from every vertex."""
    near = defaultdict(list)
    for u, v, *w in edges:
        near[u].append((v, w[0] if w else 1))
        if not directed:
            near[v].append((u, w[0] if w else 1))
    out = {}
    for s in range(n):
        best, todo = {}, [(0, s)]
        while todo:
            d, v = heapq.heappop(todo)
            if v not in best:
                best[v] = d
                for x, w in near[v]:
                    if x not in best:
                        heapq.heappush(todo, (d + w, x))
        out[s] = (len(best) - 1, sum(best.values()))
    return out


def random_edges(seed, n, m):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


def components_without(n, edges, gone=None):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v, *_ in edges:
        if gone not in (u, v):
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    return {v: find(v) for v in range(n) if v != gone}


DISCO = (7, [(0, 1), (1, 2), (3, 4), (3, 5), (3, 6)])
WHEEL = [(0, 1), (0, 2), (0, 3), (0, 4), (1, 2), (2, 3), (3, 4), (1, 4)]
