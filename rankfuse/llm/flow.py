"""Minimum-cost flow on a small graph (primal-dual: a blocking flow at each distance)."""

from __future__ import annotations

import heapq
from collections import defaultdict


class Network:
    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, room: int, cost: int) -> int:
        """Adds an edge and its reverse; the number of the edge."""
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def used(self, edge: int) -> int:
        return self.room[edge ^ 1]

    def solve(self, start: int, end: int) -> int:
        """Sends as much as fits at the least cost (costs must be 0 or more); returns the amount."""
        n, height, sent = len(self.out), [0] * len(self.out), 0
        while True:
            far = [float("inf")] * n
            far[start], queue = 0, [(0, start)]
            while queue:
                d, v = heapq.heappop(queue)
                if d > far[v]:
                    continue
                for e in self.out[v]:
                    w, at = self.to[e], d + self.cost[e] + height[v] - height[self.to[e]]
                    if self.room[e] and at < far[w]:
                        far[w] = at
                        heapq.heappush(queue, (at, w))
            if far[end] == float("inf"):
                return sent
            height = [h + min(f, far[end]) for h, f in zip(height, far)]
            sent += self._block(start, end, height)

    def _block(self, start: int, end: int, height: list[int]) -> int:
        """Paths along edges of reduced cost 0, until none is left."""
        sent, at = 0, [0] * len(self.out)
        path: list[int] = []
        on = {start}
        v = start
        while True:
            if v == end:
                room = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= room
                    self.room[e ^ 1] += room
                sent += room
                path, on, v = [], {start}, start
                continue
            while at[v] < len(self.out[v]):
                e = self.out[v][at[v]]
                w = self.to[e]
                if self.room[e] and w not in on and self.cost[e] + height[v] == height[w]:
                    break
                at[v] += 1
            if at[v] < len(self.out[v]):
                path.append(self.out[v][at[v]])
                v = self.to[path[-1]]
                on.add(v)
            elif v == start:
                return sent
            else:
                on.discard(v)
                v = self.to[path.pop() ^ 1]
                at[v] += 1


def transfers(old: list[int], new: list[int]) -> list[list[tuple[int, int]]]:
    """For each old shard its blocks ``(new shard, bytes)``, in order; the fewest bytes move.

    Bytes that stay in the shard of the same number cost 0, others 1. ``sum(old) == sum(new)``.
    All moves pass one hub, so the graph has as many edges as shards and not as pairs.
    """
    m, n = len(old), len(new)
    start, hub, end, total = m + n, m + n + 1, m + n + 2, sum(old)
    net = Network(m + n + 3)
    stay, leave, enter = {}, [], []
    for i, size in enumerate(old):
        net.edge(start, i, size, 0)
        if i < n:
            stay[i] = net.edge(i, m + i, total, 0)
        leave.append(net.edge(i, hub, total, 1))
    for j, size in enumerate(new):
        enter.append(net.edge(hub, m + j, total, 0))
        net.edge(m + j, end, size, 0)
    if net.solve(start, end) != total:
        raise ValueError("the new capacities don't hold the old shards")
    blocks: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, e in stay.items():
        if net.used(e):
            blocks[i].append((i, net.used(e)))
    room = [[j, net.used(e)] for j, e in enumerate(enter) if net.used(e)]
    for i, e in enumerate(leave):
        left = net.used(e)
        while left:
            j, free = room[0]
            take = min(left, free)
            blocks[i].append((j, take))
            left -= take
            room[0][1] -= take
            if not room[0][1]:
                room.pop(0)
    return [blocks[i] for i in range(m)]
