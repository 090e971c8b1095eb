"""Cycles of one graph of nodes 0 to n - 1, in numpy. A cycle is told by its set of nodes, starts at the smallest, and has the lexically smallest order that the graph allows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np

#: Orders of two, three and four nodes behind the smallest, lexically.
ORDERS = {n: np.array([(0, *p) for p in permutations(range(1, n))]) for n in (2, 3, 4)}
ROWS = 1 << 16


def matrix(n: int, a, b) -> np.ndarray:
    """255 where an edge leads from a row's node to a column's other node, else 0, so that `and` passes any mark."""
    m = np.zeros((n, n), np.uint8)
    m[a, b] = 255
    np.fill_diagonal(m, 0)
    return m


def _live(m: np.ndarray, a: int) -> np.ndarray:
    """The nodes above a on closed walks of at most four edges from a through nodes above it."""
    above = np.arange(len(m)) > a
    to, back = [(m[a] > 0) & above], [(m[:, a] > 0) & above]
    for _ in range(2):
        to.append(to[-1] | m[to[-1]].any(0) & above)
        back.append(back[-1] | m[:, back[-1]].any(1) & above)
    return np.flatnonzero(to[0] & back[2] | to[1] & back[1] | to[2] & back[0])


def _marks(m: np.ndarray, a: int, longest: int) -> Iterator[tuple[int, int, np.ndarray, int, np.ndarray, np.ndarray]]:
    """For each b above a: the place of b among the live nodes, b, the live nodes above b, and the marks of sets (a, b), of (a, b, c) by c, and of (a, b, c, d) by c and d. A mark
    is 0 without a cycle, else the number of orders less the place of the first that is one."""
    live = _live(m, a)
    upper = np.triu(np.full((len(live), len(live)), 255, np.uint8), 1)
    onward = m[np.ix_(live, live)]
    backward, onward = onward.T & upper, onward & upper
    for j, b in enumerate(live.tolist()):
        r, k = live[j + 1 :], slice(j + 1, None)
        ab, ba, ac, ca, bc, cb = m[a, b], m[b, a], m[a, r], m[r, a], m[b, r], m[r, b]
        three, four = np.zeros(len(r), np.uint8), np.zeros((len(r), len(r)), np.uint8)
        if longest > 2:
            three = np.maximum(ab & bc & ca & 2, ac & cb & ba & 1)
        if longest > 3:
            for mark, may, between, c, d in (
                (6, ab, onward, bc, ca),  # a b c d
                (5, ab, backward, ca, bc),  # a b d c
                (4, 255, upper, ac & cb, bc & ca),  # a c b d
                (3, ba, onward, ac, cb),  # a c d b
                (2, 255, upper, bc & ca, ac & cb),  # a d b c
                (1, ba, backward, cb, ac),  # a d c b
            ):
                if may and (i := np.flatnonzero(c)).size and d.any():
                    four[i] = np.maximum(four[i], between[k, k][i] & (d & mark))
        yield j, b, r, int(ab & ba & 1), three, four


def listed(m: np.ndarray, starts, longest: int = 4) -> Iterator[np.ndarray]:
    """Cycles of two to `longest` (at most four) nodes whose smallest node is among the starts, as arrays of a row each; an array has one length."""
    held: dict[int, list[np.ndarray]] = {n: [] for n in ORDERS}
    size = dict.fromkeys(ORDERS, 0)

    def keep(n, sets, marks):
        if len(sets):
            held[n].append(np.take_along_axis(sets, ORDERS[n][len(ORDERS[n]) - marks], 1))
            size[n] += len(sets)

    for a in starts:
        for _, b, r, two, three, four in _marks(m, a, longest):
            pair = np.array([[a, b]])
            keep(2, pair[:two], np.array([1])[:two])
            c = np.flatnonzero(three)
            keep(3, np.hstack([pair.repeat(len(c), 0), r[c, None]]), three[c])
            c, d = np.nonzero(four)
            keep(4, np.hstack([pair.repeat(len(c), 0), r[c, None], r[d, None]]), four[c, d])
            for n in ORDERS:
                if size[n] >= ROWS:
                    yield np.concatenate(held[n])
                    held[n], size[n] = [], 0
    for n in ORDERS:
        if held[n]:
            yield np.concatenate(held[n])


def counted(m: np.ndarray, starts, longest: int = 4) -> np.ndarray:
    """By length (0 to 4) and node: the cycles that `listed` gives, without listing them."""
    n = np.zeros((5, len(m)), np.int64)
    for a in starts:
        pairs = np.zeros((0, 0), np.uint32)  # of c and d, over all b
        live = np.zeros(0, np.int64)
        for j, b, r, two, three, four in _marks(m, a, longest):
            if j == 0:
                live = np.append(b, r)
                pairs = np.zeros((len(live), len(live)), np.uint32)
            some = four > 0
            pairs[j + 1 :, j + 1 :] += some
            n[2, [a, b]] += two
            n[3, r] += three > 0
            n[3, [a, b]] += np.count_nonzero(three)
            n[4, [a, b]] += np.count_nonzero(some)
        n[4, live] += pairs.sum(0, np.int64) + pairs.sum(1, np.int64)
    return n


NONE = -(1 << 20)  # the saving of an edge that isn't there


def savings(n: int, a, b, cost) -> np.ndarray:
    """The bits of eight that an edge saves."""
    s = np.full((n, n), NONE, np.int32)
    s[a, b] = 8 - cost
    np.fill_diagonal(s, NONE)
    return s


def bounds(s: np.ndarray, a: int, longest: int) -> np.ndarray:
    """By number k of edges and node: the most that a walk from there to a over nodes above a can save with 1 to k edges (with `longest`: from a itself, too)."""
    n = len(s)
    exact, most = s[:, a].copy(), np.full((longest + 1, n), NONE, np.int32)
    for k in range(1, longest + 1):
        most[k] = np.maximum(most[k - 1], exact)
        if k < longest:
            exact = np.maximum((s[:, a + 1 :] + exact[a + 1 :]).max(1, initial=NONE), NONE)
    return most


def gaining(s: np.ndarray, a: int, most: np.ndarray, longest: int, floor: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(nodes, gains) of all orders of all cycles from a, their smallest node, that gain at least floor; paths that can't reach it by their bound are left."""
    if most[longest, a] < floor:
        return
    todo = [(np.array([[a]]), np.zeros(1, np.int32))]
    while todo:
        path, saved = todo.pop()
        last, length = path[:, -1], path.shape[1]
        if length > 1:
            gain = saved + s[last, a]
            if (ok := gain >= floor).any():
                yield path[ok], gain[ok]
        if length < longest:
            on = saved[:, None] + s[last, a + 1 :]
            may = on + most[longest - length, a + 1 :] >= floor
            row, to = np.nonzero(may)
            new = (path[row] != to[:, None] + a + 1).all(1)
            row, to = row[new], to[new]
            path, saved = np.hstack([path[row], to[:, None] + a + 1]), on[row, to]
            todo += [(path[k : k + 4096], saved[k : k + 4096]) for k in range(0, len(path), 4096)]


def first_order(s: np.ndarray, nodes: list[int]) -> tuple[list[int], int]:
    """Of a set of nodes that has a gaining cycle, the lexically smallest order that gains, and its gain."""
    nodes = sorted(nodes)
    n = len(nodes)
    own = s[np.ix_(nodes, nodes)]
    exact = [own[:, 0]]
    for _ in range(n - 2):
        exact.append(np.maximum((own[:, 1:] + exact[-1][1:]).max(1), NONE))
    own, exact = own.tolist(), [x.tolist() for x in exact]

    def go(path, saved, left):
        x = path[-1]
        if not left:
            return ([nodes[i] for i in path], saved + own[x][0]) if saved + own[x][0] > 0 else None
        for y in left:
            if saved + own[x][y] + exact[len(left) - 1][y] > 0 and (found := go([*path, y], saved + own[x][y], [z for z in left if z != y])):
                return found
        return None

    return go([0], 0, list(range(1, n)))


def all_gaining(s: np.ndarray, starts, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(nodes, gains) of gaining cycles of two to `longest` nodes from these starts: of each set the lexically smallest order that gains."""
    for a in starts:
        by_length: dict[int, list] = {}
        for path, gain in gaining(s, a, bounds(s, a, longest), longest, 1):
            by_length.setdefault(path.shape[1], []).append((path, gain))
        for n, got in by_length.items():
            path, gain = np.concatenate([p for p, _ in got]), np.concatenate([g for _, g in got])
            order = np.lexsort([*path.T[::-1], *np.sort(path, 1).T[::-1]])
            sets = np.sort(path[order], 1)
            kept = order[np.append(True, (sets[1:] != sets[:-1]).any(1))]
            yield path[kept], gain[kept]


def best_gaining(s: np.ndarray, longest: int, k: int) -> list[tuple[list[int], int]]:
    """The k first of `all_gaining` by gain (descending), length and nodes. The order that stands for a set gains no more than the set's best order. So, if all sets with an
    order of at least some gain are known, and k of them stand at that gain or more, no other can come before: the least gain looked for falls until that is so."""
    most = [bounds(s, a, longest) for a in range(len(s))]
    top = max((int(most[a][longest, a]) for a in range(len(s))), default=0)
    known: dict[frozenset, tuple[list[int], int]] = {}
    for floor in range(top, 0, -1):
        for a in range(len(s)):
            for path, _ in gaining(s, a, most[a], longest, floor):
                for nodes in path.tolist():
                    if (key := frozenset(nodes)) not in known:
                        known[key] = first_order(s, nodes)
        if sum(g >= floor for _, g in known.values()) >= k:
            break
    return sorted(known.values(), key=lambda x: (-x[1], len(x[0]), x[0]))[:k]
