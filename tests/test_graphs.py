"""Triangles against brute force, and the rows that their joins make."""

import itertools
import random

from fluvia.plans.graphs import triangles


def brute(pairs):
    near = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            near.setdefault(min(a, b), set()).add(max(a, b))
    return sorted((x, y, z) for x, ys in near.items() for y, z in itertools.combinations(sorted(ys), 2) if z in near.get(y, ()))


def joined(plan):
    """Output rows of every join of an executed plan."""
    name, children = plan.nodeName(), []
    if name.startswith("AdaptiveSparkPlan"):
        children = [plan.executedPlan()]
    elif "QueryStage" in name:
        children = [plan.plan()]
    elif not name.startswith("ReusedExchange"):
        children = [plan.children().apply(k) for k in range(plan.children().size())]
    own = [plan.metrics().apply("numOutputRows").value()] if "Join" in name else []
    return own + [n for c in children for n in joined(c)]


def test_triangles_of_any_graph(spark):
    """Stars around a full core, where starts lie on either side of an edge; repeated and turned edges, loops, nulls."""
    draw = random.Random(5)
    core = list(itertools.combinations(range(12), 2))
    leaves = [(n, c) for n in range(100, 160) for c in draw.sample(range(12), draw.choice([1, 2, 3]))]
    loose = [(draw.randrange(40, 100), draw.randrange(40, 100)) for _ in range(300)]
    hub = [(500, n) for n in range(40, 160)]
    pairs = core + leaves + loose + hub + [(b, a) for a, b in leaves[:40]] + core[:9] + [(7, 7), (None, 3), (4, None), (None, None)]
    for told in (1 << 19, 20, 0):  # all degrees, those of some nodes, or none are broadcast
        got = sorted(map(tuple, triangles(spark.createDataFrame(pairs, "a bigint, b bigint"), told).collect()))
        assert got == brute(pairs) and len(got) > 300
    assert triangles(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_triangles_look_up_few_pairs(spark):
    """Nodes with 50 edges to larger ones would make 1,225 pairs each; ends that start few edges are asked instead."""
    parts = [(10_000 + p, s) for p in range(120) for s in random.Random(p).sample(range(40), 30)] + [(10_000 + p, 100 + n) for p in range(120) for n in range(20)]
    pairs = parts + [(s, 100 + s % 20) for s in range(40)] + [(200 + k, n) for n in range(100, 120) for k in range(60)]
    df = triangles(spark.createDataFrame(pairs, "a bigint, b bigint").repartition(4))
    assert len(df.collect()) == len(brute(pairs)) == 3600
    assert max(joined(df._jdf.queryExecution().executedPlan())) <= 2 * len(pairs)
