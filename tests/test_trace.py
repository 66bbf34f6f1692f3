"""The trace operators against hand-made traces and plain restatements."""

import random

import pytest

from tracewright.operators import clock, links, stats, workflow
from tracewright.operators.automaton import TraceError, run_thread
from tracewright.operators.components import contract
from tracewright.plans.spec import Master, Registry, SpecError
from tracewright.sources import tracelog


def _master():
    m = Master("w", Registry().register("svc", "c"))
    _, n1 = m.build_thread("c", 1, "open", "req")
    _, n2 = n1.build(2, "work")
    _, n3 = n2.build(3, "close")
    n3.set_state("DONE")
    return m


def test_segmentation_restart_dangling_and_abandoned():
    a = _master().compile()
    kws = ["noise", "open", "work", "close", "open", "work", "noise", "close", "open"]
    rows = run_thread(a, ["c"] * len(kws), kws)
    assert [r[0] for r in rows] == ["dangling", "start", "step", "step", "start", "step", "dangling", "dangling", "start"]
    assert [r[1] for r in rows] == [None, 0, 0, 0, 1, 1, None, None, 2]
    assert rows[3][8] == "DONE" and rows[3][10] and not rows[4][10]
    assert rows[6][12] == "e2->n2"


def test_substring_keywords_first_edge_wins_and_conflict_is_one_sided():
    m = Master("w", Registry().register("svc", "c"))
    _, n1 = m.build_thread("c", 1, "x")
    n1.build(2, "abc")
    n1.build(3, "ab")  # a later, shorter keyword is legal
    with pytest.raises(SpecError):
        n1.build(4, "abcd")
    a = m.compile()
    assert a.step(a.names.index("n1"), (), "zabcz")[1] == a.names.index("n2")
    assert a.step(a.names.index("n1"), (), "zabz")[1] == a.names.index("n3")


def test_function_call_consumes_its_first_line_and_returns():
    m = Master("w", Registry().register("svc", "c"))
    _, f1, f = m.build_func(10, "enter", "f")
    f1.build_endf("leave")
    _, n1 = m.build_thread("c", 1, "open")
    _, n2 = n1.build(2, f)
    n2.build(3, "close")
    rows = run_thread(m.compile(), ["c"] * 4, ["open", "enter", "leave", "close"])
    assert [r[0] for r in rows] == ["start", "step", "step", "step"]
    assert [r[7] for r in rows][-2:] == ["n2", "n3"] and rows[-1][10]


def test_two_end_states_are_fatal():
    m = Master("w", Registry().register("svc", "c"))
    _, n1 = m.build_thread("c", 1, "a")
    n1.set_state("X")
    _, n2 = n1.build(2, "b")
    n2.set_state("Y")
    with pytest.raises(TraceError):
        run_thread(m.compile(), ["c", "c"], ["a", "b"])


def _greedy(f, t):
    out, used = [], set()
    for ti, tk in sorted(t, key=lambda x: x[::-1]):
        for fi, fk in sorted(f, key=lambda x: x[::-1]):
            if fi not in used:
                used.add(fi)
                out.append((fi, ti))
                break
    return sorted(out)


def test_rank_zip_is_the_greedy_scan(spark):
    rng = random.Random(1)
    f = [(f"f{i}", rng.randrange(3), rng.randrange(20)) for i in range(30)]
    t = [(f"t{i}", rng.randrange(3), rng.randrange(20)) for i in range(40)]
    fd, td = (spark.createDataFrame(x, "pace_id string, k int, us long") for x in (f, t))
    got = sorted((r.from_id, r.to_id) for r in links.link(fd, td, ["k"]).collect())
    want = sorted(p for k in range(3) for p in _greedy([(i, u) for i, kk, u in f if kk == k], [(i, u) for i, kk, u in t if kk == k]))
    assert got == want
    anyone = links.link(fd, td, ["k"], "ANY").collect()
    assert len(anyone) == len(t) and len({r.from_id for r in anyone}) == 3


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 480)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in contract(spark.createDataFrame(edges, "a int, b int")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[find(a)] = find(b)
    groups = {}
    for n in parent:
        groups.setdefault(find(n), set()).add(n)
    assert set(got) == set(parent)
    for members in groups.values():
        assert len({got[m] for m in members}) == 1
    assert len(set(got.values())) == len(groups)


def test_clock_solver_meets_bounds_and_refuses_contradictions():
    bounds = [("a", "b", 5.0, 9.0), ("b", "c", -4.0, -1.0), ("a", "d", None, 3.0)]
    x = clock.solve(bounds)
    for a, b, low, high in bounds:
        assert (low is None or x[a] - x[b] >= low) and (high is None or x[a] - x[b] <= high)
    with pytest.raises(ValueError):
        clock.solve([("a", "b", 5.0, 3.0)])


def test_union_measure(spark):
    iv = [("x", 0, 10), ("x", 2, 5), ("x", 10, 12), ("x", 20, 25), ("y", 1, 1)]
    got = {r.k: (r.busy, r.added) for r in stats.union_measure(spark.createDataFrame(iv, "k string, from_us long, to_us long"), ["k"]).collect()}
    assert got == {"x": (17, 20), "y": (0, 0)}


def test_fold_keeps_the_graph_acyclic():
    into = workflow.fold([("a", None, "a", 5), ("a>b", "a", "b", 3), ("c", None, "c", 2), ("c>b", "c", "b", 2), ("a>b>a", "a>b", "a", 1)])
    assert into["c>b"] == into["a>b"] and into["a>b>a"] != into["a"]


def test_scan_and_parse(spark, tmp_path):
    (tmp_path / "h1.ctraces").write_text(
        "[10:00:00.000100000] (+0.000001) h1:fio:4242 op:send: { cpu_id = 0 }, { pthread_id = 77 }, { oreq = 5, name = }\nother line\n[10:00:01.5] (+0.1) h1:fio:4242 op:done: { c = 0 }, { pthread_id = 77 }, { oreq = 5 }\n"
    )
    (tmp_path / "out1.ctraces").write_text("skipped")
    rows = tracelog.parse(tracelog.scan(spark, str(tmp_path), ("ctraces",), skip="^out"), "op", {"fio": "client"}).orderBy("lino").collect()
    assert [(r.lino, r.keyword, r.thread, r.target, r.host) for r in rows] == [(1, "send", "77", "fio:4242", "h1"), (3, "done", "77", "fio:4242", "h1")]
    assert rows[0].vars == {"pthread_id": "77", "oreq": "5"} and abs(rows[1].seconds - 36001.5) < 1e-9
    with pytest.raises(ValueError):
        tracelog.report([("a", 1), ("a", 2)], spark)


def test_entry_and_a_few_queries_match_duckdb(spark):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "nation", "region", "customer"):
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    q, sql = entry.queries(), entry.oracle_sql()
    for name in ("automaton_steps", "link_two_rules_consumed", "refresh_version", "connected_components", "projection_by_key", "profiling_bands", "workflow_bands", "thread_index", "zero_base"):
        df = q[name](spark, "/root/testdata/sf0.001")
        r = con.execute(sql[name])
        cols = [c[0] for c in r.description]
        assert sorted(map(repr, (tuple(x[c] for c in cols) for x in df.collect()))) == sorted(map(repr, r.fetchall())), name


def test_segmentation_of_a_stream_keeps_its_state_between_batches(spark, tmp_path):
    from tracewright.streaming.segment import segment_stream

    a = _master().compile()
    lines = [("t", i, "c", k) for i, k in enumerate(["noise", "open", "work", "close", "open", "work", "noise"])] + [("u", 0, "c", "open"), ("u", 1, "c", "close")]
    schema = "thread string, lino long, component string, keyword string"
    query = None
    for upto, rows in ((0, [x for x in lines if x[1] < 2]), (1, [x for x in lines if x[1] >= 2])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = segment_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")), a)
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert query.awaitTermination(120)
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("thread", "lino").collect():
        got.setdefault(r.thread, []).append((r.status, r.ti))
    whole = run_thread(a, ["c"] * 7, [x[3] for x in lines[:7]])
    assert got["t"] == [(r[0], r[1]) for r in whole]
    assert got["u"] == [("start", 0), ("dangling", None)]
