"""Graph kernels for one component at a time, on edges as pairs of numbers."""

from __future__ import annotations

import math
from collections import defaultdict, deque
from heapq import heappop, heappush


def adjacency(edges) -> dict:
    near = defaultdict(set)
    for u, v in edges:
        if u != v:
            near[u].add(v)
            near[v].add(u)
    return near


def bridges(edges) -> set[tuple]:
    """Edges without which their component falls apart, found with a stack of its own."""
    near, order, low, out = adjacency(edges), {}, {}, set()
    for root in near:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack = [(root, None, iter(near[root]))]
        while stack:
            u, parent, rest = stack[-1]
            for v in rest:
                if v not in order:
                    order[v] = low[v] = len(order)
                    stack.append((v, u, iter(near[v])))
                    break
                if v != parent:
                    low[u] = min(low[u], order[v])
            else:
                stack.pop()
                if stack:
                    p = stack[-1][0]
                    low[p] = min(low[p], low[u])
                    if low[u] > order[p]:
                        out.add((min(p, u), max(p, u)))
    return out


def components(nodes, edges) -> list[set]:
    near, seen, out = adjacency(edges), set(), []
    for n in nodes:
        if n not in seen:
            part, todo = {n}, [n]
            while todo:
                for v in near[todo.pop()]:
                    if v not in part:
                        part.add(v)
                        todo.append(v)
            seen |= part
            out.append(part)
    return out


def complement_forest(nodes, closed) -> list[tuple]:
    """(node, parent) of a spanning forest of the pairs that are not ``closed``, breadth first from the least node of each tree.

    A parent is the least node of the level before that is open to the node. Time grows with the
    nodes and closed pairs.
    """
    shut, left, out = adjacency(closed), sorted(nodes), []
    while left:
        level, left = [left[0]], left[1:]
        while level:
            found = []
            for p in level:
                stays = shut[p]
                out += [(n, p) for n in left if n not in stays]
                found += [n for n in left if n not in stays]
                left = [n for n in left if n in stays]
            level = sorted(found)
    return out


class Flow:
    """Residual network of an undirected graph with capacities."""

    def __init__(self, weighted):
        self.room = defaultdict(dict)
        for u, v, w in weighted:
            self.room[u][v] = self.room[u].get(v, 0) + w
            self.room[v][u] = self.room[v].get(u, 0) + w

    def push(self, s, t, limit=float("inf"), changes: dict | None = None) -> float:
        """Flow from s to t along shortest augmenting paths, until ``limit`` is reached; ``changes`` gets the capacities before."""
        total = 0.0
        while total < limit:
            came, queue = {s: None}, deque([s])
            while queue and t not in came:
                u = queue.popleft()
                for v, w in self.room[u].items():
                    if w > 1e-12 and v not in came:
                        came[v] = u
                        queue.append(v)
            if t not in came:
                break
            path, v = [], t
            while came[v] is not None:
                path.append((came[v], v))
                v = came[v]
            step = min(self.room[u][v] for u, v in path)
            for u, v in path:
                if changes is not None:
                    changes.setdefault((u, v), self.room[u][v])
                    changes.setdefault((v, u), self.room[v][u])
                self.room[u][v] -= step
                self.room[v][u] += step
            total += step
        return total

    def reaching(self, t) -> set:
        """Nodes with a way to ``t`` in what is left: the least side of t in a minimum cut."""
        side, todo = {t}, [t]
        while todo:
            v = todo.pop()
            for u in self.room[v]:
                if u not in side and self.room[u].get(v, 0) > 1e-12:
                    side.add(u)
                    todo.append(u)
        return side


class CutNetwork:
    """Cuts between many pairs of one component, from one residual network that is put back after each."""

    def __init__(self, weighted):
        self.weighted = list(weighted)
        self.flow = Flow(self.weighted)
        self.empty = all(w <= 0 for *_, w in self.weighted)

    def lighter_cut(self, s, t, most: float) -> list[tuple] | None:
        """The edges of the minimum cut with the least side of t, or None if it weighs more than ``most``; no more flow than that is pushed."""
        if self.empty:
            return min_cut(self.weighted, s, t)[1] if most >= 0 else None
        changes: dict = {}
        total = self.flow.push(s, t, math.nextafter(most, math.inf), changes)
        cut = None
        if total <= most:
            side = self.flow.reaching(t)
            cut = sorted((min(u, v), max(u, v)) for u, v, _ in self.weighted if (u in side) != (v in side))
        for (u, v), w in changes.items():
            self.flow.room[u][v] = w
        return cut


def min_cut(weighted, s, t) -> tuple[float, list[tuple]]:
    """Weight and edges of the minimum cut with the least side of t."""
    if all(w <= 0 for *_, w in weighted):
        return 0.0, sorted((min(u, v), max(u, v)) for u, v, _ in weighted if (u == t) != (v == t))
    flow = Flow(weighted)
    total = flow.push(s, t)
    side = flow.reaching(t)
    return total, sorted((min(u, v), max(u, v)) for u, v, _ in weighted if (u in side) != (v in side))


def connectivity_at_least(nodes, edges, k: int) -> bool:
    """Whether the graph is k-edge-connected; fewer than k + 1 nodes never are."""
    nodes = list(nodes)
    if len(nodes) < k + 1 or len(components(nodes, edges)) > 1:
        return False
    if k == 1:
        return True
    near = adjacency(edges)
    if any(len(near[n]) < k for n in nodes):
        return False
    if k == 2:
        return not bridges(edges)
    unit = [(u, v, 1) for u, v in edges]
    return all(Flow(unit).push(nodes[0], n, k) >= k for n in nodes[1:])


def augmented(nodes, edges, k: int, available=None, partial: bool = False, closed=()) -> list[tuple] | None:
    """Edges to add so that the graph is k-edge-connected, from ``available`` or all absent pairs but ``closed`` ones.

    One level at a time, each edge joins two parts that less than that level connects: at level
    1 components, at 2 the leaf blocks between bridges, beyond that ends of too small cuts.
    None if it cannot be done; with ``partial`` as far as it goes.
    """
    nodes, have, chosen = sorted(nodes), {(min(e), max(e)) for e in edges}, []
    if len(nodes) < k + 1 and not partial:
        return None
    pool = None if available is None else {(min(e), max(e)) for e in available} - have
    shut = {(min(e), max(e)) for e in closed}

    def candidates(side_a, side_b):
        for u in sorted(side_a):
            for v in sorted(side_b):
                e = (min(u, v), max(u, v))
                if e not in have and e not in shut and (pool is None or e in pool):
                    yield e

    def add(side_a, side_b) -> bool:
        if pool is not None and len(pool) < len(side_a) * len(side_b):
            e = next((e for e in sorted(pool) if e not in have and e not in shut and ((e[0] in side_a and e[1] in side_b) or (e[1] in side_a and e[0] in side_b))), None)
        else:
            e = next(candidates(side_a, side_b), None)
        if e:
            have.add(e)
            chosen.append(e)
        return e is not None

    for level in range(1, min(k, max(1, len(nodes) - 1)) + 1):
        stuck = set()
        while True:
            parts = _weak_parts(nodes, have, level, stuck)
            if parts is None:
                break
            side, other, preferred = parts
            if not ((preferred and add(side, preferred)) or add(side, other)):
                if not partial:
                    return None
                stuck.add(frozenset(side))
    if not partial and not connectivity_at_least(nodes, have, k):
        return None
    return chosen


def _weak_parts(nodes, have, level, stuck):
    """A part with fewer than ``level`` edges to the rest, the rest, and a part that should be joined to it."""
    every = set(nodes)
    if level == 1:
        parts = [p for p in components(nodes, have) if frozenset(p) not in stuck]
        return None if len(parts) < 2 and (not parts or parts[0] == every) else (parts[0], every - parts[0], None)
    if level == 2:
        cut = bridges(have)
        blocks = components(nodes, have - cut)
        of = {n: i for i, b in enumerate(blocks) for n in b}
        degree = defaultdict(int)
        for u, v in cut:
            degree[of[u]] += 1
            degree[of[v]] += 1
        leaves = [blocks[i] for i in range(len(blocks)) if degree[i] <= 1 and len(blocks) > 1 and frozenset(blocks[i]) not in stuck]
        return (leaves[0], every - leaves[0], leaves[len(leaves) // 2] if len(leaves) > 1 else None) if leaves else None
    for n in nodes[1:]:
        flow = Flow([(u, v, 1) for u, v in have])
        if flow.push(nodes[0], n, level) < level:
            side = flow.reaching(n)
            if frozenset(side) not in stuck:
                return side, every - side, None
    return None


def sparse_assignment(profit: list[dict], columns: int) -> list[int | None]:
    """For each row the column of an assignment of the most rows, and of these of the most profit; None for a row that gets none.

    ``profit``: for each row its possible columns with what they bring. Each row in turn is added
    by a cheapest augmenting path, found with potentials and a heap, or dropped for one of those
    that its search reached, if that brings more.
    """
    most = 1 + sum(max(p.values(), default=0) for p in profit)
    # A row can always take a column of its own that brings less than any gain elsewhere.
    cost = [{j: most - w for j, w in p.items()} | {columns + i: most * (len(profit) + 1)} for i, p in enumerate(profit)]
    owner: dict[int, int] = {}
    own: dict[int, int] = {}
    u, v = [0.0] * len(profit), defaultdict(float)
    for i in range(len(profit)):
        least, came, done, heap = {}, {}, {}, []
        row, base = i, 0.0
        while True:
            for j, c in cost[row].items():
                d = base + c - u[row] - v[j]
                if j not in done and d < least.get(j, float("inf")):
                    least[j], came[j] = d, row
                    heappush(heap, (d, j))
            while heap[0][1] in done:
                heappop(heap)
            base, j = heappop(heap)
            if j not in owner:
                break
            done[j] = base
            row = owner[j]
        u[i] += base
        for k, d in done.items():
            u[owner[k]] += base - d
            v[k] -= base - d
        row = None
        while row != i:
            row = came[j]
            owner[j], own[row], j = row, j, own.get(row)
    out: list[int | None] = [None] * len(profit)
    for j, row in owner.items():
        out[row] = j if j < columns else None
    return out


def _joined(edges, parent: dict) -> list[bool]:
    """Whether each edge joins two parts that were apart; ``parent`` gets the links."""

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in edges:
        a, b = root(a), root(b)
        out.append(a != b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return out


def forest(edges) -> list[bool]:
    """Whether each edge, in order, closes no cycle with those before it."""
    return _joined(edges, {})


def stars(edges) -> list[tuple]:
    """(node, the least node that it reaches) of all nodes that are not the least themselves."""
    parent: dict = {}
    _joined(edges, parent)
    out = {}
    for x in sorted(parent):
        # A link leads to a lesser node, whose end is known by now.
        out[x] = out[parent[x]] if parent[x] != x else x
    return [(x, r) for x, r in out.items() if x != r]
