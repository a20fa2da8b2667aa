"""Minimum cuts of small graphs by augmenting paths in level graphs (Dinic, 1970)."""

from __future__ import annotations


def min_cut(terminal: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stand on the source's side of a minimum cut; of several cuts, the one with the fewest such nodes.

    ``terminal`` holds each node's capacity from the source minus its capacity
    to the sink (what both share is cut in any case); ``edges`` are ``a, b,
    capacity`` in both directions.
    """
    n = len(terminal)
    left = list(terminal)
    arcs: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[int] = []
    for a, b, capacity in edges:
        if a != b and capacity > 0:
            arcs[a].append(len(to))
            arcs[b].append(len(to) + 1)
            to += (b, a)
            room += (capacity, capacity)
    while True:
        level = [-1] * n
        queue = [v for v in range(n) if left[v] > 0]
        sources, met = list(queue), False
        for v in queue:
            level[v] = 0
        for v in queue:
            met = met or left[v] < 0
            for e in arcs[v]:
                u = to[e]
                if room[e] and level[u] < 0:
                    level[u] = level[v] + 1
                    queue.append(u)
        if not met:
            return [x >= 0 for x in level]
        at = [0] * n
        for source in sources:
            v, path = source, []
            while left[source] > 0:
                if left[v] < 0:
                    flow = min([left[source], -left[v], *(room[e] for e in path)])
                    left[source] -= flow
                    left[v] += flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    v, path = source, []
                    continue
                own = arcs[v]
                while at[v] < len(own) and not (room[own[at[v]]] and level[to[own[at[v]]]] == level[v] + 1):
                    at[v] += 1
                if at[v] < len(own):
                    path.append(own[at[v]])
                    v = to[path[-1]]
                elif path:
                    v = to[path.pop() ^ 1]
                    at[v] += 1
                else:
                    break
