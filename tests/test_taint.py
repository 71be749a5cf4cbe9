import os
import random

import pytest

from evidentia.operators import taint
from evidentia.session import shared_dir


def brute(edges, sources, sinks, most, hops):
    out = []
    for t in set(sinks):
        for s in set(sources) - {t}:
            paths, stack = [], [[s]]
            while stack:
                p = stack.pop()
                if p[-1] == t:
                    paths.append(p)
                elif len(p) <= hops:
                    stack += [[*p, b] for a, b in set(edges) if a == p[-1] and b not in p]
            out += [(t, s, k, len(p) - 1, p) for k, p in enumerate(sorted(paths, key=lambda p: (len(p), p))[:most], 1)]
    return sorted(out)


def frames(spark, edges, sources, sinks):
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "node string")
    return spark.createDataFrame(edges, "source string, target string"), one(sources), one(sinks)


@pytest.mark.parametrize("seed", range(3))
def test_flow_paths_equal_all_simple_paths(spark, seed):
    """Random graphs with cycles, edges to the node itself, repeated edges, and more paths than are wanted."""
    rng = random.Random(seed)
    nodes = [f"n{k}" for k in range(9)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(26)]
    edges += edges[:3]
    sources, sinks = rng.sample(nodes, 3), rng.sample(nodes, 3)
    got = taint.flow_paths(*frames(spark, edges, [*sources, sources[0]], sinks), most=2, hops=5).collect()
    assert sorted((r.sink, r.source, r["rank"], r.length, r.steps) for r in got) == brute(edges, sources, sinks, 2, 5)


def test_left_out_paths_come_back(spark):
    """The first ways to x all pass y, from which the only way on leads back into them: a later way is needed."""
    edges = [("s", f"a{k}") for k in range(5)] + [(f"a{k}", "y") for k in range(5)] + [("y", "x"), ("s", "z"), ("z", "w"), ("w", "x"), ("x", "y"), ("y", "t"), ("x", "q"), ("q", "y")]
    got = taint.flow_paths(*frames(spark, edges, ["s"], ["t"]), most=1, hops=6).collect()
    assert [r.steps for r in got] == [b[-1] for b in brute(edges, ["s"], ["t"], 1, 6)]
    got = taint.flow_paths(*frames(spark, edges, ["s"], ["t"]), most=8, hops=6).collect()
    assert sorted(r.steps for r in got) == sorted(b[-1] for b in brute(edges, ["s"], ["t"], 8, 6))


def test_no_paths(spark):
    assert taint.flow_paths(*frames(spark, [("a", "b"), (None, "b")], ["b", None], ["a", None])).collect() == []
    assert taint.flow_paths(*frames(spark, [], ["a"], ["a", "b"])).collect() == []


def test_sink_flows_have_steps(spark):
    calls = spark.createDataFrame([(k, f"c{k}", "f.js", 10 * k, "m") for k in range(6)], "id bigint, code string, filename string, line_number int, containing string")
    edges = spark.createDataFrame([(0, 2), (2, 3), (0, 3), (1, 3), (1, 2), (4, 5)], "source bigint, target bigint")
    sinks = calls.filter("id in (3, 5)").selectExpr("id", "'Injection' AS category", "code")
    got = {r.sink_id: r.paths for r in taint.sink_flows(edges, calls, sinks, calls.filter("id < 2"), most=3).collect()}
    assert set(got) == {3} and [[s.code for s in p.steps] for p in got[3]] == [["c0", "c3"], ["c1", "c3"], ["c0", "c2", "c3"]]
    assert (got[3][2].source, got[3][2].sink, got[3][2].steps[1].line_number, got[3][2].steps[1].method) == ("c0", "Injection: c3", 20, "m")


def test_layers_grow_with_nodes_and_not_with_pairs(spark, monkeypatch):
    """Every source reaches every node: what a layer holds are ways of nodes to sinks, not of sources to nodes."""
    edges = [(f"s{a}", f"x{b}") for a in range(40) for b in range(10)] + [(f"x{a}", f"y{b}") for a in range(10) for b in range(10)] + [(f"y{a}", f"t{b}") for a in range(10) for b in range(2)]
    rows, write = [], taint.saved
    monkeypatch.setattr(taint, "saved", lambda df, name: rows.append((name, (out := write(df, name)).count())) or out)
    got = taint.flow_paths(*frames(spark, edges, [f"s{a}" for a in range(40)], ["t0", "t1"]), most=3, hops=3)
    assert got.count() == 40 * 2 * 3 and [r.steps for r in got.filter("sink = 't1' and source = 's7'").orderBy("rank").collect()] == [["s7", "x0", f"y{k}", "t1"] for k in range(3)]
    assert sum(n for name, n in rows if name == "flow-layer") <= 2 * 20


def test_edges_carry_no_ways(spark):
    """What is shuffled for an edge from a source doesn't grow with the names of the nodes on the ways behind it."""
    rng = random.Random(1)
    name = lambda k: f"{k}" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=400))
    inner = [(f"a{k}", name(3 * k + j)) for k in range(200) for j in range(3)]
    edges = inner + [(b, "t") for _, b in inner]
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(store.executorList(False).apply(k).totalShuffleWrite() for k in range(store.executorList(False).size()))
    took = []
    for n in (20, 120):
        starts, before = [f"s{k}" for k in range(n)], written()
        got = taint.flow_paths(*frames(spark, edges + [(s, f"a{k}") for s in starts for k in rng.sample(range(200), 40)], starts, ["t"]), most=3, hops=3)
        assert got.count() == 3 * n
        took.append(written() - before)
    assert took[1] - took[0] < 100 * 40 * 300


def test_sources_go_in_runs(spark, monkeypatch):
    """No run has the offers of all sources, and what no later step reads is gone at the end."""
    rng = random.Random(5)
    nodes = [f"n{k}" for k in range(9)]
    edges, sources, sinks = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(26)], nodes[:5], nodes[4:7]
    runs, write = [], taint.saved
    monkeypatch.setattr(taint, "saved", lambda df, name: runs.append(name) or write(df, name))
    monkeypatch.setattr(taint, "EDGES", 4)
    there = set(os.listdir(shared_dir(spark)))
    got = taint.flow_paths(*frames(spark, edges, sources, sinks), most=2, hops=5).collect()
    assert sorted((r.sink, r.source, r["rank"], r.length, r.steps) for r in got) == brute(edges, sources, sinks, 2, 5)
    assert runs.count("flow-picks") > 1
    left = {f.rsplit("-", 1)[0] for f in set(os.listdir(shared_dir(spark))) - there}
    assert "flow-picks" in left and not left & {"flow-edges", "flow-known-edges", "flow-offers"}
