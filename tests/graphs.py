"""Small graphs with known answers, and plain Python oracles."""

import heapq

POWER_LAW = {
    "dist": [0, 2, 1, 1, 2, 1, 1, 1, 1, 2, 1, 1, 1, 2, 1, 1, 1, 2, 2, 1, 2, 1, 2, 1, 2],
}
NEGATIVE_EDGES = [(0, 1, 1), (1, 2, 2), (2, 3, 3), (3, 4, 0), (1, 5, 1), (5, 3, 1), (1, 6, 10), (6, 7, -11), (7, 8, -1), (8, 3, 1)]
NEGATIVE_CYCLE = [(0, 1, 2), (2, 3, 4), (1, 2, -1), (2, 1, -1), (1, 4, 1), (4, 5, 1), (5, 2, 1)]
WEIGHTED = [(0, 1, 10), (1, 2, 10), (2, 3, 10), (4, 0, 1), (4, 1, 2), (4, 2, 3), (4, 3, 4), (5, 0, 4), (5, 1, 3), (5, 2, 2), (5, 3, 1)]
DISCONNECTED = [(0, 1, 1), (1, 2, 2), (2, 0, 3), (3, 4, 1), (4, 5, 2), (5, 3, 3)]


def both(pairs):
    return sorted({(a, b) for a, b in pairs} | {(b, a) for a, b in pairs})


def complete(n):
    return [(a, b) for a in range(n) for b in range(n) if a != b]


def frame(spark, edges):
    edges = list(edges)
    weighted = bool(edges) and len(edges[0]) == 3
    rows = [(a, b, float(w)) for a, b, w in edges] if weighted else edges
    return spark.createDataFrame(rows, "src long, dst long" + (", weight double" if weighted else ""))


def levels(edges, root):
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
    dist, front = {root: 0}, [root]
    while front:
        new = []
        for v in front:
            for w in near.get(v, ()):
                if w not in dist:
                    dist[w] = dist[v] + 1
                    new.append(w)
        front = new
    return dist


def greedy(vertices, edges):
    near = {}
    for a, b in edges:
        if b > a:
            near.setdefault(a, set()).add(b)
    colour = {}
    for v in sorted(vertices, reverse=True):
        used = {colour[w] for w in near.get(v, ())}
        colour[v] = next(c for c in range(len(used) + 1) if c not in used)
    return colour


def shortest(edges, source):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
    best, heap = {}, [(0, source)]
    while heap:
        d, v = heapq.heappop(heap)
        if v not in best:
            best[v] = d
            for b, w in near.get(v, ()):
                heapq.heappush(heap, (d + w, b))
    return best
