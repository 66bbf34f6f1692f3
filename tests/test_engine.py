"""Declared workflows run end to end, on hand-made traces with results worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import automaton as A
from tracewright.operators import clock, links, report, requests
from tracewright.operators.components import contract
from tracewright.plans import frames
from tracewright.plans.api import Intervals, Requests
from tracewright.plans.engine import Trace
from tracewright.plans.spec import Master, Registry, SpecError
from tracewright.sources import tracelog
from tracewright.sources.driver import Driver, DriverError

_LINES = "source string, target string, thread string, lino long, host string, component string, keyword string, us long, vars map<string,string>"


def _lines(spark, rows):
    """rows: target, thread, host, component, keyword, us, vars; lino is the place in the list."""
    return spark.createDataFrame([("s", t, th, i + 1, h, c, k, us, v) for i, (t, th, h, c, k, us, v) in enumerate(rows)], _LINES)


def _calling():
    """A client sends to a server and waits for it; the server's answer is another request, entered and left."""
    m = Master("m", Registry().register("svc", "client", "server", "store"))
    e1, n1 = m.build_thread("client", 1, "begin", "order")
    e2, n2 = n1.build(2, "send")
    e3, n3 = n2.build(3, "done")
    n3.set_state("OK")
    e4, n10 = m.build_thread("server", 10, "recv")
    e5, _ = n10.build(11, "reply")
    e6, n20 = m.build_thread("store", 20, "enter", "save")
    _, n21 = n20.build(21, "write")
    e8, n22 = n21.build(22, "leave")
    n22.set_state("SAVED")
    e2.join_one(e4, True, ["id"])
    e5.join_one(e3, True, ["id"], "save").call_req(e6, True, ["id"], e8, True, ["id"])
    return m


_CALL = [
    ("c:1", "1", "h1", "client", "begin", 10, {"id": "7"}),
    ("c:1", "1", "h1", "client", "send", 20, {"id": "7"}),
    ("s:1", "1", "h2", "server", "recv", 30, {"id": "7"}),
    ("s:1", "1", "h2", "server", "reply", 40, {"id": "7"}),
    ("d:1", "1", "h3", "store", "enter", 50, {"id": "7"}),
    ("d:1", "1", "h3", "store", "write", 60, {"id": "7"}),
    ("d:1", "1", "h3", "store", "leave", 70, {"id": "7"}),
    ("c:1", "1", "h1", "client", "done", 80, {"id": "7"}),
]


def test_a_nested_call_leads_the_main_path_through_the_callee(spark):
    t = Trace(_lines(spark, _CALL), _calling())
    got = {(r.kind, r.from_id.split("#")[-1], r.to_id.split("#")[-1]): r.remote_type for r in t.links.collect()}
    assert got == {("inner", "2", "3"): "remote", ("cross_in", "4", "5"): "remote", ("nested", "5", "7"): "local", ("cross_out", "7", "8"): "remote"}
    groups = {r.request_type: r for r in t.groups.collect()}
    assert {k: list(g.errors) for k, g in groups.items()} == {"order": [], "save": []}
    order = groups["order"]
    assert (order.len_threadinss, order.len_paces, order.len_hosts, order.from_us, order.last_us) == (2, 3, 2, 10, 80)
    main = [(r.kind, r.from_id.split("@")[0].split("#")[-1], r.to_id.split("@")[0].split("#")[-1]) for r in t.main_path.where(F.col("group_id") == order.group_id).orderBy("pos").collect()]
    assert main == [("thread", "1", "2"), ("link", "2", "3"), ("thread", "3", "4"), ("link", "4", "5"), ("link", "5", "7"), ("link", "7", "8")]
    assert order.len_main_paces == 8  # seven paces on the way, two of them the callee's, and the activity after the last
    own = [(r.kind, r.pos) for r in t.main_path.where(F.col("group_id") == groups["save"].group_id).collect()]
    assert sorted(own) == [("thread", 0), ("thread", 1)]  # the call does not lead the callee's own request astray
    assert sorted(r.request for r in t.requests.collect()) == ["order1", "save1"]
    vars_ = {r.key: r["values"] for r in t.request_vars.where(F.col("group_id") == order.group_id).collect()}
    assert vars_["id"] == ["7"] and vars_["host"] == ["h1", "h2"]
    joins = t.join_intervals.where(F.col("group_id") == order.group_id)
    assert {(r.int_type, r.is_main, r.lapse) for r in joins.collect()} == {("inner", True, 10), ("cross_in", True, 10), ("nested", True, 20), ("cross_out", True, 10)}
    assert {r.path for r in t.thread_intervals.where("is_main").collect()} == {"e1[n1]e2", "e4[n10]e5", "e6[n20]e7", "e7[n21]e8"}
    callee = t.members.select("ti_id", "group_id")
    assert [(r.group_id, r.n) for r in report.nested_counts(t.links, callee).collect()] == [(groups["save"].group_id, 1)]
    detail = report.request_detail(order.group_id, t.groups, t.request_vars, t.thread_intervals).collect()
    assert {r.section for r in detail} == {"request", "vars", "interval"}


def test_the_tables_of_a_trace(spark):
    t = Trace(_lines(spark, _CALL), _calling())
    assert {(r.target, r.component, r.host) for r in frames.targets(t).collect()} == {("c:1", "client", "h1"), ("s:1", "server", "h2"), ("d:1", "store", "h3")}
    joins = {(r.request, r.int_type): r for r in frames.join_intervals(t).collect()}
    r = joins["order1", "inner"]
    assert (r.path, r.desc, r.hosts, r.order, r.is_main, r.from_time, r.to_thread) == ("e2[j_e2>e4]e4", "e2[j_e2>e4]e4: send -> recv", "h1 -> h2", 1, True, "00:00:00.000020", "1")
    assert abs(r.lapse - 1e-5) < 1e-12 and len(joins) == 4
    threads = frames.thread_intervals(t).collect()
    assert sorted((x.request, x.path) for x in threads if x.is_main) == [("order1", "e1[n1]e2"), ("order1", "e4[n10]e5"), ("save1", "e6[n20]e7"), ("save1", "e7[n21]e8")]
    table = {x.request: x for x in frames.request_table(t).collect()}
    assert (table["order1"].path, table["order1"].request_state, table["order1"].len_main_paces, table["save1"].len_paces) == ("e1[order]e3", "OK", 8, 2)
    assert abs(table["order1"].lapse - 7e-5) < 1e-12 and table["order1"].last_time == "00:00:00.000080"
    assert {(x.request, x.id) for x in frames.request_vars(t, ["id"]).collect()} == {("order1", "7"), ("save1", "7")}
    with pytest.raises(ValueError, match="host"):
        frames.request_vars(t, ["host", "id"])


def test_a_call_that_is_not_left_stays_a_plain_request_link(spark):
    rows = [r for r in _CALL if r[4] != "leave"]
    t = Trace(_lines(spark, rows), _calling())
    assert sorted(r.kind for r in t.links.collect()) == ["inner", "request"]
    errors = {r.request_type: list(r.errors) for r in t.groups.collect()}
    assert errors["order"] == [] and errors["save"] == ["no end", "incomplete"]


def test_misses_name_their_rules_and_strays_do_no_harm(spark):
    rows = [*_CALL[:4], ("s:2", "9", "h2", "server", "recv", 35, {"id": "8"}), _CALL[7]]
    t = Trace(_lines(spark, rows), _calling())
    assert {(r.side, r.rules, r.pace_id.split("#")[-1]) for r in t.misses.collect()} == {("to", "e2>e4", "5")}
    # an instance that is only linked into the request, not reached from its start, is stray
    inst = spark.createDataFrame([("a", "q", None, True), ("b", None, "END", True), ("x", None, None, False)], "ti_id string, request_type string, request_state string, is_complete boolean")
    inst = inst.select("*", *[F.lit(1).cast("long").alias(c) for c in ("from_us", "to_us", "n_paces")], *[F.lit("1").alias(c) for c in ("host", "target", "thread")])
    ways = spark.createDataFrame([("a", "b"), ("x", "b")], "from_ti string, to_ti string")
    m = requests.members(inst, requests.groups(inst, ways), ways)
    got = requests.build(m).first()
    assert (got.n_strays, got.len_threadinss, list(got.errors)) == (1, 2, [])
    none = requests.build(requests.members(inst.where("ti_id = 'x'"), requests.groups(inst.where("ti_id = 'x'"), ways.limit(0)), ways.limit(0))).first()
    assert list(none.errors) == ["no start"]


def test_a_chain_of_sixty_links_is_walked_to_its_start(spark):
    n = 60
    p = [("g", f"p{i}.{s}", f"t{i}", s, i == 0 and s == 0, i == n and s == 1) for i in range(n + 1) for s in range(2)]
    paces = spark.createDataFrame(p, "group_id string, pace_id string, ti_id string, seq int, is_start boolean, is_end boolean")
    ways = spark.createDataFrame([(f"p{i}.1", f"p{i + 1}.0") for i in range(n)], "from_id string, to_id string")
    path, verdicts = requests.main_paths(paces, ways)
    got = [(r.kind, r.from_id, r.to_id) for r in path.orderBy("pos").collect()]
    want = [x for i in range(n + 1) for x in (("thread", f"p{i}.0", f"p{i}.1"), ("link", f"p{i}.1", f"p{i + 1}.0"))][:-1]
    assert got == want and [(r.failure, r.len_main_paces) for r in verdicts.collect()] == [(None, 2 * n + 3)]
    seen = requests.reached(spark.createDataFrame([("t0",)], "ti_id string"), spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(n)], "from_ti string, to_ti string"))
    assert seen.count() == n + 1


def test_broken_main_paths_say_why(spark):
    p = [("round", "a0", "a", 0, True, False), ("round", "a1", "a", 1, True, True), ("two", "b0", "b", 0, True, True), ("two", "c0", "c", 0, True, False), ("two", "d0", "d", 0, True, False), ("lost", "f0", "f", 0, False, True), ("ends", "h0", "h", 0, True, True), ("ends", "h1", "h", 1, True, True)]
    paces = spark.createDataFrame(p, "group_id string, pace_id string, ti_id string, seq int, is_start boolean, is_end boolean")
    ways = spark.createDataFrame([("a1", "a0"), ("c0", "b0"), ("d0", "b0")], "from_id string, to_id string")
    path, verdicts = requests.main_paths(paces, ways)
    assert {r.group_id: r.failure for r in verdicts.collect()} == {"round": "revisited", "two": "several links", "lost": "no start"} and path.count() == 0


def test_segmentation_of_one_hot_thread_in_small_batches(spark):
    m = Master("w", Registry().register("svc", "c"))
    _, n1 = m.build_thread("c", 1, "open", "req")
    _, n2 = n1.build(2, "work")
    n2.build(n2, "work")
    n2.build(3, "close")
    a, rng = m.compile(), random.Random(5)
    rows = [("s", "t", "hot" if i % 2 else f"x{i % 7}", i, "c", rng.choice(["open", "work", "work", "close", "noise", None]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "source string, target string, thread string, lino long, component string, keyword string, extra long")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        got = {(r.thread, r.lino): tuple(r[c] for c in ("status", "ti", "seq", "is_complete", "is_finish", "position", "failed_on", "is_error", "extra")) for r in A.segment(df, a).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    for th in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == th]
        for r, w in zip(own, A.run_thread(a, ["c"] * len(own), [r[5] or "" for r in own]), strict=True):
            assert got[th, r[3]] == (w[0], w[1], w[2], w[10], w[11], w[12], w[13], w[14], r[6])
    assert A.segment(df.limit(0), a).count() == 0


def test_shared_edges_merged_graphs_and_conflicts():
    m = Master("w", Registry().register("svc", "c"))
    _, n1 = m.build_thread("c", 1, "a", "req")
    _, n2 = n1.build(2, "b")
    e, n3 = n2.build(3, "z")
    e.refresh_var("id")
    assert n1.build(n3, e)[0] is e and n1.edges[-1].refresh == ["id"]
    _, n4 = n1.build(4, "d")
    assert n4.build(3, e)[0] is e  # by the id of the edge's own node
    with pytest.raises(SpecError):
        n4.build(2, e)
    assert [x.name for x in m.iter_edges()].count(e.name) == 1 and m.refreshes() == {e.name: ["id"]}
    _, n10 = m.build_thread("c", 10, "other")
    assert len(m.graphs) == 2
    n10.build(n2, "over")  # an edge into the other graph makes one of the two
    assert len(m.graphs) == 1 and n10.graph is n1.graph and len(m.graphs[0].starts) == 2
    rows = A.run_thread(m.compile(), ["c"] * 3, ["other", "over", "z"])
    assert [r[0] for r in rows] == ["start", "step", "step"] and rows[-1][10]


def test_clocks_by_hand():
    # two hosts bounded on both sides: the first at 0, the other in the middle of [-9, -5]
    assert clock.solve([("a", "b", 5.0, 9.0)]) == {"a": 0.0, "b": -7.0}
    # slack 2, from the narrower pair; b stands in two pairs and is fixed first; both others keep the slack
    assert clock.solve([("a", "b", 5.0, 9.0), ("b", "c", -30.0, -10.0)]) == {"b": 0.0, "a": 7.0, "c": 12.0}
    # a one-sided pair takes no slack from the others and stays at 0 if it can
    assert clock.solve([("a", "b", None, 3.0)]) == {"a": 0.0, "b": 0.0}
    assert clock.solve([("a", "b", 4.0, None)]) == {"a": 0.0, "b": -4.0}
    for bad in ([("a", "b", 5.0, 3.0)], [("a", "b", 2.0, 3.0), ("b", "c", 2.0, 3.0), ("a", "c", 0.0, 1.0)]):
        with pytest.raises(ValueError):
            clock.solve(bad)


def test_violated_links_are_mended_by_the_offsets(spark):
    rows = [("h1", "h2", 100, 160), ("h2", "h1", 200, 190), ("h1", "h3", 10, 15), ("h3", "h1", 30, 60)]
    x = spark.createDataFrame(rows, "from_host string, to_host string, from_us long, to_us long")
    assert clock.violated_pairs(clock.pair_bounds(x)).count() == 1 and clock.violations(x).count() == 1
    off = clock.offsets(x)
    assert clock.still_violated(x, off).count() == 0
    lines = spark.createDataFrame([("h2", "a", 5), ("h2", "b", 5)], "host string, target string, us long")
    moved = {r.target: r.us for r in clock.apply_offsets(lines, off, spark.createDataFrame([("a",)], "target string")).collect()}
    assert moved["b"] == 5 and moved["a"] == int(5 + {r.host: r.offset for r in off.collect()}["h2"])


def test_components_in_rounds_and_in_one_task_agree(spark):
    rng = random.Random(2)
    edges = spark.createDataFrame([(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(260)], "a string, b string")
    parts = []
    for one_task in (0, 40, 10**6):
        got = {}
        for r in contract(edges, one_task=one_task).collect():
            got.setdefault(r.root, set()).add(r.node)
        parts.append(sorted(map(sorted, got.values())))
    assert parts[0] == parts[1] == parts[2]


def test_numbers_of_requests_are_those_of_a_plain_ranking(spark):
    rng = random.Random(3)
    rows = [(f"g{i:03d}", rng.choice("ab"), rng.randrange(50)) for i in range(300)]
    got = {r.group_id: r.request for r in requests.auto_names(spark.createDataFrame(rows, "group_id string, request_type string, from_us long")).collect()}
    for kind in "ab":
        for i, r in enumerate(sorted((r for r in rows if r[1] == kind), key=lambda r: (r[2], r[0]))):
            assert got[r[0]] == f"{kind}{i + 1}"


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(f"line {i}\n" if i % 5 else "\n" for i in range(1, 4001)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r.lino: r.line for r in tracelog.scan(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == {i: f"line {i}" for i in range(1, 4001) if i % 5}


def test_a_driver_reads_a_folder_and_runs_its_workflow(spark, tmp_path):
    m = Master("m", Registry().register("svc", "client", "server"))
    e1, n1 = m.build_thread("client", 1, "begin", "order")
    e2, n2 = n1.build(2, "done")
    n2.set_state("OK")
    e3, n10 = m.build_thread("server", 10, "recv")
    e4, _ = n10.build(11, "reply")
    e1.join_one(e3, True, ["id"])
    e4.join_one(e2, True, ["id"])
    (tmp_path / "h1.log").write_text("0.1 h1 client:1 begin 5\n0.2 h1 client:1 skip 5\n0.5 h1 client:1 done 5\n")
    (tmp_path / "h2.log").write_text("0.2 h2 server:1 recv 5\n0.3 h2 server:1 reply 5\n")
    (tmp_path / "out.log").write_text("0.2 h2 other:1 recv 5\n")

    def _accept(line, v):  # defined here, so that it is sent to the workers with its code
        clock_, host, who, keyword, number = line.split()
        v |= {"time": clock_, "seconds": float(clock_), "target": who, "thread": "1", "component": who.split(":")[0], "keyword": keyword, "id": number, "none": ""}
        return keyword != "skip"

    def accept_file(folder, name, v):
        v["host"] = name.split(".")[0]
        return not name.startswith("out")

    t = Driver(m, _accept, accept_file).load(spark, str(tmp_path))
    r = t.requests.first()
    assert (r.request, r.request_state, r.from_us, r.last_us, r.len_hosts, r.n_strays) == ("order1", "OK", 100_000, 500_000, 2, 0)
    assert [x.kind for x in t.main_path.orderBy("pos").collect()] == ["link", "thread", "link"]
    with pytest.raises(DriverError, match="no line of server"):
        Driver(m, _accept, lambda f, n, v: v.update(host="h1") or n.startswith("h1")).load(spark, str(tmp_path))
    with pytest.raises(ValueError, match="keyword"):
        Driver(m, _accept, lambda f, n, v: v.update(keyword="x") or True).lines(spark, str(tmp_path))
    assert str(DriverError("a", DriverError("b", ValueError("c")))) == "a\n> b\n> > ValueError('c')"


def test_named_misses_for_all_name_each_rule(spark):
    items = spark.createDataFrame([("p",), ("q",)], "pace_id string")
    got = spark.createDataFrame([("p", "r1"), ("p", "r2"), ("q", "r1")], "from_id string, rule string")
    assert [(r.pace_id, r.rules) for r in links.named_misses(items, got, "from", ["r1", "r2"], "ALL").collect()] == [("q", "r2")]
    assert [(r.pace_id, r.rules) for r in links.named_misses(items, got.where("from_id = 'p'"), "from", ["r1", "r2"]).collect()] == [("q", "r1/r2")]


def test_csv_sink_appends(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "key string, value int")
    for _ in range(2):
        tracelog.append_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def test_chains_over_intervals_and_requests(spark):
    rows = [("thread", "p1", "n1", 1, 5), ("thread", "p2", "n2", 1, 9), ("link", "p3", "q", 1, 2)]
    x = Intervals(spark.createDataFrame(rows, "kind string, path string, int_name string, order int, lapse int"))
    assert x.threads.one_kind().frame.count() == 2 and x.joins.one_kind().frame.count() == 1 and x.by_path("none").one_kind() is None
    with pytest.raises(ValueError):
        x.one_kind()
    assert [r.int_name for r in x.names().collect()] == ["n1", "n2", "q"] and x.orders().count() == 1
    assert x.longest().first().path == "p2" and x.shortest().first().path == "p3"
    r = Requests(spark.createDataFrame([("a1", "a", {"k": "1"}, 3), ("a2", "a", {"k": "2", "l": "x"}, 4)], "request string, request_type string, vars map<string,string>, len_paces int"))
    assert [q.request for q in r.by_kv("k", "2").frame.collect()] == ["a2"] and [q.key for q in r.keys().collect()] == ["k", "l"]
    assert r.by_name("a1").count() == 1 and r.by_type("b").frame.count() == 0
    with pytest.raises(KeyError):
        r.by_name("zz")
    assert r.distribution("len_paces").count() == 2 and r.distribution("len_paces", most=1).first().p50 == 3.5
