"""Minimum cut of small graphs with terminal capacities."""

from __future__ import annotations


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node falls on the source side of a minimum cut.

    ``gain[i]`` > 0 is the capacity from the source, < 0 that to the sink; ``edges`` are undirected with
    a capacity. Nodes whose terminal capacity exceeds all their edges are certain; their edges
    become terminal capacities of the neighbours, until no more node is certain. The
    rest is solved by augmenting shortest paths; without any excess on a cut the sink side is taken.
    """
    n = len(gain)
    gain = list(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    total = [0.0] * n
    for a, b, c in edges:
        if a != b and c > 0:
            near[a][b] = near[a].get(b, 0.0) + c
            near[b][a] = near[b].get(a, 0.0) + c
            total[a] += c
            total[b] += c
    side: list[bool | None] = [None] * n
    ready = [i for i in range(n) if abs(gain[i]) >= total[i]]
    while ready:
        i = ready.pop()
        if side[i] is not None:
            continue
        side[i] = own = gain[i] > 0
        for j, c in near[i].items():
            if side[j] is None:
                gain[j] += c if own else -c
                total[j] -= c
                del near[j][i]
                if abs(gain[j]) >= total[j]:
                    ready.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if not rest:
        return [bool(s) for s in side]
    residual = {i: dict(near[i]) for i in rest}
    source = {i: gain[i] for i in rest if gain[i] > 0}
    sink = {i: -gain[i] for i in rest if gain[i] < 0}
    eps = 1e-9
    while True:
        # shortest augmenting path from any node with source capacity to any with sink capacity
        parent: dict[int, int] = {}
        queue = [i for i, c in source.items() if c > eps]
        for i in queue:
            parent[i] = -1
        end = -1
        for i in queue:
            if sink.get(i, 0.0) > eps:
                end = i
                break
            for j, c in residual[i].items():
                if c > eps and j not in parent:
                    parent[j] = i
                    queue.append(j)
        if end < 0:
            break
        path, i = [end], end
        while parent[i] >= 0:
            i = parent[i]
            path.append(i)
        flow = min(source[path[-1]], sink[end])
        for b, a in zip(path, path[1:]):
            flow = min(flow, residual[a][b])
        source[path[-1]] -= flow
        sink[end] -= flow
        for b, a in zip(path, path[1:]):
            residual[a][b] -= flow
            residual[b][a] = residual[b].get(a, 0.0) + flow
    for i in rest:
        side[i] = i in parent
    return [bool(s) for s in side]
