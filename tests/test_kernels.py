from itertools import combinations, product

from hypothesis import given, settings
from hypothesis import strategies as st

from pairwright.functions import codes
from pairwright.operators import kernels as k

EDGES = st.sets(st.tuples(st.integers(0, 6), st.integers(0, 6)).filter(lambda e: e[0] < e[1]), max_size=14)


def connected(nodes, edges):
    return len(k.components(nodes, edges)) == 1


def connectivity(nodes, edges):
    """The most edges any of which can go without the graph falling apart, and one more."""
    for n in range(len(edges) + 1):
        if any(not connected(nodes, [e for e in edges if e not in gone]) for gone in combinations(edges, n)):
            return n
    return len(edges) + 1


@settings(max_examples=150, deadline=None)
@given(EDGES)
def test_bridges_and_connectivity(edges):
    nodes = sorted({n for e in edges for n in e})
    before = len(k.components(nodes, edges))
    assert k.bridges(edges) == {e for e in edges if len(k.components(nodes, edges - {e})) > before}
    for want in (1, 2, 3):
        assert k.connectivity_at_least(nodes, edges, want) == (len(nodes) > want and connectivity(nodes, sorted(edges)) >= want)


@settings(max_examples=150, deadline=None)
@given(EDGES, st.lists(st.integers(0, 5), min_size=14, max_size=14))
def test_min_cut_has_the_least_weight_and_side(edges, weights):
    weighted = [(u, v, w) for (u, v), w in zip(sorted(edges), weights, strict=False)]
    nodes = {n for e in edges for n in e}
    if not {0, 1} <= nodes:
        return
    sides = [{1, *extra} for n in range(len(nodes)) for extra in combinations(sorted(nodes - {0, 1}), n)]
    cost = lambda side: sum(w for u, v, w in weighted if (u in side) != (v in side))
    best = min(map(cost, sides))
    total, cut = k.min_cut(weighted, 0, 1)
    assert total == best
    least = min((s for s in sides if cost(s) == best), key=len)
    reaching = sorted((u, v) for u, v, w in weighted if (u in least) != (v in least))
    assert sum(w for u, v, w in weighted if (u, v) in set(cut)) == best
    assert {e for e in cut if dict(((u, v), w) for u, v, w in weighted)[e]} == {e for e in reaching if dict(((u, v), w) for u, v, w in weighted)[e]}


@settings(max_examples=100, deadline=None)
@given(EDGES, st.integers(1, 3))
def test_augmentation_is_feasible(edges, want):
    nodes = list(range(7))
    added = k.augmented(nodes, edges, want)
    assert added is not None and not set(added) & edges
    assert k.connectivity_at_least(nodes, edges | set(added), want)
    assert k.augmented([0, 1], [], 1, available=[]) is None
    assert k.augmented([0, 1], [], 1, available=[], partial=True) == []


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 4).flatmap(lambda n: st.lists(st.dictionaries(st.integers(0, n), st.integers(1, 9), max_size=n + 1), min_size=1, max_size=5)))
def test_sparse_assignment_fills_most_rows_with_most_profit(profit):
    columns = 5
    got = k.sparse_assignment(profit, columns)
    used = [j for j in got if j is not None]
    assert len(set(used)) == len(used) and all(j is None or j in profit[i] for i, j in enumerate(got))
    value = lambda choice: (sum(j is not None for j in choice), sum(profit[i][j] for i, j in enumerate(choice) if j is not None))
    every = [c for c in product(*[[None, *p] for p in profit]) if len({j for j in c if j is not None}) == sum(j is not None for j in c)]
    assert value(got) == max(map(value, every))


@settings(max_examples=200, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 6), st.integers(0, 6)).filter(lambda e: e[0] < e[1])))
def test_complement_forest_spans_what_is_open(closed):
    nodes = range(7)
    open_ = {e for e in combinations(nodes, 2) if e not in closed}
    links = k.complement_forest(nodes, closed)
    assert {(min(e), max(e)) for e in links} <= open_
    parts = sorted(map(sorted, k.components(nodes, open_)))
    assert sorted(map(sorted, k.components(nodes, links))) == parts and len(links) == 7 - len(parts)


def test_viewpoints():
    d = codes.view_distance
    assert [d("back", x) for x in ("back", "upback", "left", "upfront", "front")] == [0, 1, 2, 3, 4]
    assert d("back", None) is None and d("unknown", "left") is None
    assert all(d(a, b) == d(b, a) <= 4 for a in codes.VIEWS for b in codes.VIEWS)
