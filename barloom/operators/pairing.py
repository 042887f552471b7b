"""Least-cost pairing of many rows on the number of differing fields, without a matrix of all pairs."""

from __future__ import annotations

import itertools
from collections import defaultdict, deque
from collections.abc import Sequence

import numpy as np
import pandas as pd

Hub = tuple[np.ndarray, np.ndarray, int]


def clusters(a: np.ndarray, b: np.ndarray, tolerance: float, numeric: bool) -> tuple[np.ndarray, np.ndarray]:
    """Cluster of each value of one field, left rows before right ones, and whether it is loose.

    Values of different clusters differ; those of one agree, unless the cluster is a chain longer than the tolerance (loose). Missing
    values are a cluster of their own, and so is each infinity.
    """
    if not numeric:
        codes = pd.factorize(np.concatenate([a.astype(object), b.astype(object)]))[0]
        return codes + 1, np.zeros(len(codes), dtype=bool)
    v = np.concatenate([a.astype(float), b.astype(float)])
    codes, loose = np.zeros(len(v), dtype=int), np.zeros(len(v), dtype=bool)
    there = np.flatnonzero(~np.isnan(v))
    if len(there):
        there = there[np.argsort(v[there], kind="stable")]
        s = v[there]
        with np.errstate(invalid="ignore"):
            new = s[1:] - s[:-1] > tolerance * np.maximum(np.abs(s[1:]), np.abs(s[:-1]))
            new |= (s[1:] != s[:-1]) & (np.isinf(s[1:]) | np.isinf(s[:-1]))
            starts = np.flatnonzero(np.concatenate([[True], new]))
            ends = np.concatenate([starts[1:], [len(s)]]) - 1
            wide = s[ends] - s[starts] > tolerance * np.maximum(np.abs(s[ends]), np.abs(s[starts]))
        k = np.concatenate([[0], np.cumsum(new)])
        codes[there], loose[there] = k + 1, wide[k]
    return codes, loose


def _spans(left: np.ndarray, right: np.ndarray, x: np.ndarray, y: np.ndarray, tolerance: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Groups (left rows, right rows) that cover exactly the pairs within the tolerance: the partners of a value are a span of the sorted
    values of the other side, and spans that overlap are cut along a binary tree."""
    right = right[np.argsort(y[right], kind="stable")]
    s = y[right]
    m = len(s)

    def agree(p: float, q: float) -> bool:
        return abs(p - q) <= tolerance * max(abs(p), abs(q))

    by: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i in left:
        p = x[i]
        edges = sorted((p * (1 - tolerance), p / (1 - tolerance)))
        lo, hi = int(np.searchsorted(s, edges[0], "left")), int(np.searchsorted(s, edges[1], "right"))
        while lo > 0 and agree(p, s[lo - 1]):
            lo -= 1
        while lo < hi and not agree(p, s[lo]):
            lo += 1
        while hi < m and agree(p, s[hi]):
            hi += 1
        while hi > lo and not agree(p, s[hi - 1]):
            hi -= 1
        if lo < hi:
            by[lo, hi].append(i)
    spans = sorted(by)
    if all(q[0] >= p[1] for p, q in zip(spans, spans[1:])):
        return [(np.array(by[lo, hi]), right[lo:hi]) for lo, hi in spans]
    height = max(m - 1, 1).bit_length()
    nodes: dict[int, list[int]] = defaultdict(list)
    for (lo, hi), members in by.items():
        a, z = lo + (1 << height), hi + (1 << height)
        while a < z:
            if a & 1:
                nodes[a] += members
                a += 1
            if z & 1:
                z -= 1
                nodes[z] += members
            a, z = a >> 1, z >> 1
    out = []
    for node, members in nodes.items():
        up = height - (node.bit_length() - 1)
        first = (node << up) - (1 << height)
        out.append((np.array(members), right[first:first + (1 << up)]))
    return out


def _groups(codes: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of each code that both sides have."""
    order = np.argsort(codes, kind="stable")
    cuts = np.flatnonzero(np.diff(codes[order])) + 1
    out = []
    for g in np.split(order, cuts):
        k = int(np.searchsorted(g, n))  # stable: left rows come first
        if 0 < k < len(g):
            out.append((g[:k], g[k:] - n))
    return out


def _meet(left: Sequence[int], right: Sequence[int], have: list[int], want: list[int]) -> list[tuple[int, int, int]]:
    """Pairs rows of the two lists in order as far as both last; takes them off have and want."""
    out, i, j = [], 0, 0
    while i < len(left) and j < len(right):
        p, q = int(left[i]), int(right[j])
        if n := min(have[p], want[q]):
            out.append((p, q, n))
            have[p] -= n
            want[q] -= n
        i, j = i + (have[p] == 0), j + (want[q] == 0)
    return out


def _flow(have: list[int], want: list[int], hubs: list[Hub], most: int) -> list[tuple[int, int, int]]:
    """Pairs that agree in the most fields together: cheapest flow from left rows over hubs (cost: fields not in the hub) to right rows.

    Costs are small whole numbers, so there are at most ``most`` lengths of cheapest paths; for each, blocking flows use up all paths.
    """
    lefts, rights = sorted({int(i) for h in hubs for i in h[0] if have[i]}), sorted({int(j) for h in hubs for j in h[1] if want[j]})
    at_l, at_r = {i: k + 2 for k, i in enumerate(lefts)}, {j: k + 2 + len(lefts) for k, j in enumerate(rights)}
    size = 2 + len(lefts) + len(rights) + len(hubs)
    arcs: list[list[int]] = [[] for _ in range(size)]
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []

    def link(a: int, b: int, n: int, c: int) -> None:
        arcs[a].append(len(to))
        arcs[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((n, 0))
        cost.extend((c, -c))

    for i in lefts:
        link(0, at_l[i], have[i], 0)
    for j in rights:
        link(at_r[j], 1, want[j], 0)
    endless = sum(have) + sum(want) + 1
    through: list[tuple[list[tuple[int, int]], list[tuple[int, int]]]] = []
    for k, (ls, rs, weight) in enumerate(hubs):
        hub, ins, outs = 2 + len(lefts) + len(rights) + k, [], []
        for i in ls:
            if int(i) in at_l:
                ins.append((int(i), len(to)))
                link(at_l[int(i)], hub, endless, 0)
        for j in rs:
            if int(j) in at_r:
                outs.append((int(j), len(to)))
                link(hub, at_r[int(j)], endless, most - weight)
        through.append((ins, outs))

    price = [0] * size
    while True:
        far = [-1] * size
        rows: dict[int, list[int]] = defaultdict(list)
        rows[0].append(0)
        d = 0
        while far[1] < 0 and rows:
            if d not in rows:
                d = min(rows)
            todo = rows.pop(d)
            while todo:
                u = todo.pop()
                if far[u] >= 0:
                    continue
                far[u] = d
                base = d + price[u]
                for e in arcs[u]:
                    if room[e] and far[to[e]] < 0:
                        at = base + cost[e] - price[to[e]]
                        (todo if at == d else rows[at]).append(to[e])
        if far[1] < 0 or far[1] + price[1] - price[0] >= most:
            break
        price = [p + (f if 0 <= f < far[1] else far[1]) for p, f in zip(price, far)]
        while True:
            level = [-1] * size
            level[0], queue = 0, deque([0])
            while queue and level[1] < 0:
                u = queue.popleft()
                for e in arcs[u]:
                    w = to[e]
                    if room[e] and level[w] < 0 and cost[e] + price[u] == price[w]:
                        level[w] = level[u] + 1
                        queue.append(w)
            if level[1] < 0:
                break
            turn, path, u = [0] * size, [], 0
            while True:
                if u == 1:
                    n = min(room[e] for e in path)
                    for e in path:
                        room[e] -= n
                        room[e ^ 1] += n
                    k = next(k for k, e in enumerate(path) if not room[e])
                    u = to[path[k] ^ 1]
                    del path[k:]
                    continue
                while turn[u] < len(arcs[u]):
                    e = arcs[u][turn[u]]
                    w = to[e]
                    if room[e] and level[w] == level[u] + 1 and cost[e] + price[u] == price[w]:
                        break
                    turn[u] += 1
                else:
                    if not path:
                        break
                    u = to[path.pop() ^ 1]
                    turn[u] += 1
                    continue
                path.append(e)
                u = w
    out = []
    for ins, outs in through:
        i_left, j_left = {i: room[e ^ 1] for i, e in ins}, {j: room[e ^ 1] for j, e in outs}
        out += _meet([i for i, _ in ins], [j for j, _ in outs], i_left, j_left)
    for i, j, n in out:
        have[i] -= n
        want[j] -= n
    return out


def pair_rows(left: Sequence[np.ndarray], right: Sequence[np.ndarray], have: list[int], want: list[int], numeric: Sequence[bool], tolerance: float) -> list[tuple[int, int, int]]:
    """(left row, right row, how often) for all copies of the shorter side, so that the fields that differ are fewest in total.

    ``left`` and ``right`` hold an array per field, ``have`` and ``want`` how often each row occurs; afterwards they hold what has no partner.
    Rows that agree in some fields meet in a hub of these fields; memory grows with the rows (times the subsets of fields), not the pairs.
    """
    n, k = len(have), len(left)
    marks = [clusters(a, b, tolerance, kind) for a, b, kind in zip(left, right, numeric)]

    def together(subset: Sequence[int]) -> np.ndarray:
        code = marks[subset[0]][0]
        for f in subset[1:]:
            code = np.unique(code * (int(marks[f][0].max()) + 1) + marks[f][0], return_inverse=True)[1]
        return code

    out: list[tuple[int, int, int]] = []
    if k and n and want:
        tight = ~np.any([loose for _, loose in marks], axis=0)
        # where agreement is transitive, pairs without any difference never stand in the way of a better pairing
        for ls, rs in _groups(together(range(k)), n):
            if tight[ls[0]]:
                out += _meet(ls, rs, have, want)
        kept_l, kept_r = np.array(have) > 0, np.array(want) > 0
        hubs: list[Hub] = []
        for count in range(k, 0, -1):
            for subset in itertools.combinations(range(k), count):
                for ls, rs in _groups(together(subset), n):
                    ls, rs = ls[kept_l[ls]], rs[kept_r[rs]]
                    if not len(ls) or not len(rs):
                        continue
                    parts = [(ls, rs)]
                    for f in subset:
                        if marks[f][1][ls[0]]:
                            parts = [q for p in parts for q in _spans(*p, left[f], right[f], tolerance)]
                    hubs += [(*p, count) for p in parts]
        out += _flow(have, want, hubs, k)
    return out + _meet(range(n), range(len(want)), have, want)
