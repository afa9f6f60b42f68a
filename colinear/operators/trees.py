"""Small-matrix algorithms on the driver: trees, orders, matchings.  Their input is one row an
organism or contig end, never data-sized."""

from __future__ import annotations

import heapq
import itertools
import math
import re

import numpy as np

Matrix = dict[tuple[str, str], float]


def _full(names: list[str], distance: Matrix) -> Matrix:
    return {(a, b): 0.0 if a == b else distance.get((a, b), distance.get((b, a), 1.0)) for a in names for b in names}


def upgma(names: list[str], distance: Matrix) -> str:
    """Newick tree by joining the closest clusters, distances averaged by size."""
    d, size = _full(names, distance), dict.fromkeys(names, 1)
    tree, height = {n: n for n in names}, dict.fromkeys(names, 0.0)
    while len(tree) > 1:
        a, b = min(((x, y) for x in tree for y in tree if x < y), key=lambda p: (d[p], p))
        h, new = d[a, b] / 2, f"({a},{b})"
        tree[new] = f"({tree[a]}:{h - height[a]:.6f},{tree[b]}:{h - height[b]:.6f})"
        height[new], size[new] = h, size[a] + size[b]
        for x in tree:
            if x not in (a, b, new):
                d[new, x] = d[x, new] = (d[a, x] * size[a] + d[b, x] * size[b]) / size[new]
        del tree[a], tree[b]
    return next(iter(tree.values()), "") + ";"


def neighbour_joining(names: list[str], distance: Matrix) -> tuple[dict[str, list[tuple[str, float]]], str]:
    """Unrooted tree as (adjacency, Newick)."""
    d, live = _full(names, distance), list(names)
    near: dict[str, list[tuple[str, float]]] = {n: [] for n in names}
    text = {n: n for n in names}
    while len(live) > 2:
        n = len(live)
        total = {x: sum(d[x, y] for y in live) for x in live}
        a, b = min(((x, y) for i, x in enumerate(live) for y in live[i + 1 :]),
                   key=lambda p: ((n - 2) * d[p] - total[p[0]] - total[p[1]], p))
        la = d[a, b] / 2 + (total[a] - total[b]) / (2 * (n - 2))
        lb, new = d[a, b] - la, f"_{len(near)}"
        near[new] = [(a, la), (b, lb)]
        near[a].append((new, la))
        near[b].append((new, lb))
        text[new] = f"({text[a]}:{la:.6f},{text[b]}:{lb:.6f})"
        for x in live:
            if x not in (a, b):
                d[new, x] = d[x, new] = (d[a, x] + d[b, x] - d[a, b]) / 2
        d[new, new] = 0.0
        live = [x for x in live if x not in (a, b)] + [new]
    if len(live) == 2:
        a, b = live
        near[a].append((b, d[a, b]))
        near[b].append((a, d[a, b]))
        return near, f"({text[a]}:{d[a, b] / 2:.6f},{text[b]}:{d[a, b] / 2:.6f});"
    return near, (text[live[0]] if live else "") + ";"


def midpoint_root(near: dict[str, list[tuple[str, float]]]) -> str:
    """Newick tree rooted halfway along the longest path between two leaves."""
    leaves = [n for n in near if not n.startswith("_")]

    def paths(start: str) -> dict[str, tuple[float, list[str]]]:
        out, stack = {start: (0.0, [start])}, [start]
        while stack:
            x = stack.pop()
            for y, w in near[x]:
                if y not in out:
                    out[y] = (out[x][0] + w, [*out[x][1], y])
                    stack.append(y)
        return out

    if len(leaves) < 2:
        return (leaves[0] if leaves else "") + ";"
    length, path = max((paths(a)[b] for a in leaves for b in leaves if a < b), key=lambda p: (p[0], p[1]))
    length_of = {(x, y): w for x in near for y, w in near[x]}
    gone, at = 0.0, 0
    while at < len(path) - 2 and gone + length_of[path[at], path[at + 1]] < length / 2:
        gone += length_of[path[at], path[at + 1]]
        at += 1
    a, b = path[at], path[at + 1]
    la = length / 2 - gone

    def below(x: str, parent: str) -> str:
        kids = [f"{below(y, x)}:{w:.6f}" for y, w in near[x] if y != parent]
        return f"({','.join(kids)})" if kids else x

    return f"({below(a, b)}:{la:.6f},{below(b, a)}:{length_of[a, b] - la:.6f});"


def newick_names(tree: str) -> list[str]:
    """Leaf and node names in order."""
    return [m for m in re.findall(r"[(,)]\s*([^():,;\s]+)", "(" + tree) if m]


def rename_newick(tree: str, names: dict[str, str]) -> str:
    """Names replaced as whole tokens, so no name is taken for part of another."""
    return re.sub(r"(?<=[(,)])\s*([^():,;\s]+)|^([^():,;\s]+)", lambda m: names.get(m[1] or m[2], m[1] or m[2]), tree)


def greedy_order(names: list[str], coverage: Matrix, first: str | None = None) -> list[str]:
    """Order in which each organism is followed by the unused one it shares most with (ties: name)."""
    both = lambda a, b: max(coverage.get((a, b), 0.0), coverage.get((b, a), 0.0))
    left = sorted(names)
    if not left:
        return []
    at = first or min(left, key=lambda a: (-sum(both(a, b) for b in left if b != a), a))
    out = [at]
    left.remove(at)
    while left:
        at = min(left, key=lambda b: (-both(at, b), b))
        out.append(at)
        left.remove(at)
    return out


def _assignment(cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Column of each row in the assignment of least cost, by shortest augmenting paths."""
    n = len(cost)
    row_of, u, v = np.full(n + 1, -1), np.zeros(n + 1), np.zeros(n + 1)
    for i in range(n):
        row_of[n], j = i, n
        least, way, done = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while row_of[j] >= 0:
            done[j] = True
            open_ = ~done[:n]
            step = cost[row_of[j]] - u[row_of[j]] - v[:n]
            better = open_ & (step < least)
            least[better], way[better] = step[better], j
            at = np.where(open_, least, np.inf)
            j = int(at.argmin())
            delta = at[j]
            if not np.isfinite(delta):
                return np.full(n, -1), math.inf
            u[row_of[np.flatnonzero(done)]] += delta
            v[np.flatnonzero(done)] -= delta
            least[open_] -= delta
        while j != n:
            row_of[j] = row_of[way[j]]
            j = int(way[j])
    out = np.empty(n, int)
    out[row_of[:n]] = np.arange(n)
    return out, float(cost[np.arange(n), out].sum())


def _cheapest_pairs(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of least cost that leave no node over; a finite ``cost[i, i]`` lets i stay alone.

    Half the cheapest assignment is a lower bound, and exact if its cycles are even: each is cut into the better of
    its two matchings.  An odd cycle is branched on: one of its edges is taken or forbidden, the
    cheapest bound first.
    """
    order = itertools.count()
    heap: list[tuple[float, int, float, tuple, np.ndarray, np.ndarray]] = []

    def add(own: float, pairs: tuple, left: np.ndarray, cost: np.ndarray) -> None:
        to, total = _assignment(cost[np.ix_(left, left)])
        if math.isfinite(total):
            heapq.heappush(heap, (own + total / 2, next(order), own, pairs, left, cost, to))

    add(0.0, (), np.arange(len(cost)), cost)
    while heap:
        _, _, own, pairs, left, cost, to = heapq.heappop(heap)
        seen, found, odd = np.zeros(len(left), bool), [], None
        for i in range(len(left)):
            if seen[i]:
                continue
            cycle = [i]
            while (j := int(to[cycle[-1]])) != i:
                cycle.append(j)
            seen[cycle] = True
            edges = [(int(left[a]), int(left[b])) for a, b in zip(cycle, cycle[1:] + cycle[:1])]
            if len(cycle) == 1:
                continue
            if len(cycle) % 2:
                odd = min([odd, edges] if odd else [edges], key=len)
            else:
                halves = edges[::2], edges[1::2]
                found += min(halves, key=lambda h: sum(cost[e] for e in h))
        if odd is None:
            return [*pairs, *found]
        a, b = odd[0]
        add(own + cost[a, b], (*pairs, (a, b)), left[(left != a) & (left != b)], cost)
        barred = cost.copy()
        barred[a, b] = barred[b, a] = math.inf
        add(own, pairs, left, barred)
    raise ValueError("no perfect matching")


def perfect_matching(nodes: list[str], weight: Matrix) -> list[tuple[str, str]]:
    """Perfect matching of least weight (pairs without a weight have 0); exact at every size.

    Where no weight is above 0 each connected part of the weighted pairs is solved for itself, nodes that no
    weighted pair takes are paired in order.
    """
    nodes = sorted(nodes)
    if len(nodes) % 2:
        raise ValueError("an odd number of nodes has no perfect matching")
    w = lambda a, b: weight.get((a, b), weight.get((b, a), 0.0))
    pairs = {(min(p), max(p)) for p, x in weight.items() if x and p[0] != p[1]}
    if any(w(*p) > 0 for p in pairs):
        cost = np.array([[math.inf if a == b else w(a, b) for b in nodes] for a in nodes], float)
        return sorted((nodes[min(e)], nodes[max(e)]) for e in _cheapest_pairs(cost))
    near: dict[str, set[str]] = {a: set() for a in nodes}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out, seen = [], set()
    for start in nodes:
        if start in seen or not near[start]:
            continue
        part, todo = [], [start]
        seen.add(start)
        while todo:
            part.append(todo.pop())
            new = near[part[-1]] - seen
            seen |= new
            todo += sorted(new)
        part.sort()
        cost = np.array([[0.0 if a == b else w(a, b) if b in near[a] else math.inf for b in part] for a in part], float)
        out += [(part[min(e)], part[max(e)]) for e in _cheapest_pairs(cost)]
    taken = {x for p in out for x in p}
    alone = [a for a in nodes if a not in taken]
    return sorted([*out, *zip(alone[::2], alone[1::2])])


def scaffold_paths(matching: list[tuple[str, str]], weight: Matrix) -> list[list[tuple[str, str]]]:
    """Contig paths (contig, orientation) from matched ends ``contig:head|tail``.

    Contig ends and matched ends make paths and cycles; a cycle is opened at its weakest
    adjacency (weights are negative: the largest).
    """
    mate = {}
    for a, b in matching:
        mate[a], mate[b] = b, a
    contigs = sorted({e.rsplit(":", 1)[0] for e in mate})
    other = lambda e: f"{e.rsplit(':', 1)[0]}:{'head' if e.endswith('tail') else 'tail'}"
    w = lambda a: weight.get((a, mate[a]), weight.get((mate[a], a), 0.0))
    seen: set[str] = set()

    def walk(end: str) -> list[tuple[str, str]]:
        out = []
        while end:
            contig, side = end.rsplit(":", 1)
            if contig in seen:
                break
            seen.add(contig)
            out.append((contig, "forward" if side == "head" else "reverse"))
            end = mate.get(other(end), "")
        return out

    paths = [walk(f"{c}:{s}") for c in contigs for s in ("head", "tail") if f"{c}:{s}" not in mate and c not in seen]
    for c in contigs:
        if c in seen:
            continue
        ends, end = [], f"{c}:head"
        while True:
            ends.append(end)
            end = mate[other(end)]
            if end == ends[0]:
                break
        start = max(ends, key=lambda e: (w(e), e))  # its adjacency to the end before is the weakest
        paths.append(walk(start))
    return [p for p in paths if p]
