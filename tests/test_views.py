"""Views of many roots at once against a plain queue for each."""

import random
from collections import deque

import pytest

from memspark.operators.views import bounded_view

DUTIES = ("own", "see", "test")


def plain(seeds, edges, rules, depth, max_nodes, max_edges):
    paths, nodes = [], {}
    allowed = {t: {d for d, e, _ in rules if e == t} for _, t, _ in rules}
    priority = {t: min(p for _, e, p in rules if e == t) for _, t, _ in rules}
    queue, states = deque(), {}

    def enqueue(node, valid, hops):
        kept = states.setdefault(node, [])
        if any(valid <= v and hops >= h for v, h in kept):
            return
        kept[:] = [(v, h) for v, h in kept if not (valid >= v and hops <= h)]
        kept.append((valid, hops))
        queue.append((node, valid, hops))

    for _, node, duties in sorted(seeds):
        if node not in nodes and len(nodes) < max_nodes:
            nodes[node] = len(nodes) + 1
            enqueue(node, frozenset(duties), 0)
    while queue:
        node, valid, hops = queue.popleft()
        if (valid, hops) not in states[node] or hops >= depth:
            continue
        own = sorted((priority[t], e, dst, t) for e, src, dst, t, ok in edges if src == node and ok and t in allowed)
        for _, e, dst, t in own:
            if len(paths) >= max_edges:
                return paths, nodes
            both = valid & allowed[t]
            if not both:
                continue
            if dst not in nodes:
                if len(nodes) >= max_nodes:
                    continue
                nodes[dst] = len(nodes) + 1
            paths.append((e, node, dst, tuple(sorted(both)), hops + 1))
            enqueue(dst, both, hops + 1)
    return paths, nodes


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize(("max_nodes", "max_edges"), [(6, 100), (100, 9), (8, 14)])
def test_same_paths_as_a_queue(spark, seed, max_nodes, max_edges):
    rng = random.Random(seed)
    rules = [(d, t, rng.randrange(3)) for d in DUTIES for t in "abc" if rng.random() < 0.6]
    seeds, edges, want_paths, want_nodes = [], [], [], []
    for root in range(8):
        n = rng.choice([5, 12])
        name = lambda k, root=root: f"r{root}n{k:02d}"
        own = [(f"e{root}-{k:03d}", name(rng.randrange(n)), name(rng.randrange(n)), rng.choice("abcd"), rng.random() < 0.9) for k in range(rng.choice([8, 40]))]
        some = [(k, name(rng.randrange(n)), rng.sample(DUTIES, rng.randint(1, 3))) for k in range(rng.randint(1, 2))]
        paths, nodes = plain(some, own, rules, 4, max_nodes, max_edges)
        want_paths += [(f"r{root}", k + 1, *p) for k, p in enumerate(paths)]
        want_nodes += [(f"r{root}", x, k) for x, k in nodes.items()]
        edges += own
        seeds += [(f"r{root}", *x) for x in some]
    view, nodes = bounded_view(
        spark.createDataFrame(seeds, "root string, pos int, node string, duties array<string>"),
        spark.createDataFrame(edges, "edge_id string, src string, dst string, edge_type string, confirmed boolean"),
        spark.createDataFrame(rules, "duty string, edge_type string, priority int"), 4, max_nodes, max_edges,
    )
    assert sorted((p.root, p.position, p.edge_id, p.src, p.node, tuple(p.duties), p.hops) for p in view.collect()) == sorted(want_paths)
    assert sorted((p.root, p.node, p.position) for p in nodes.collect()) == sorted(want_nodes)
