"""The registered queries over the trace model, with their SQL.

The provided `events` stand for a trace: a user is a thread, its events in time order are its lines, and the workflow is
view, click, purchase. Orders and line items serve where intervals with real durations are wanted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.operators import automaton as A
from tracewright.operators import clock, links, report, requests, stats, variables, workflow
from tracewright.plans import frames
from tracewright.plans.api import Intervals, Requests
from tracewright.plans.engine import Trace
from tracewright.plans.spec import Automaton, Master, Registry
from tracewright.sources import tracelog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL that gives the same rows where there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@cache
def shop() -> Master:
    """The example workflow."""
    master = Master("shop", Registry().register("shop", "app"))
    _, n1 = master.build_thread("app", 1, "view", "purchase")
    _, n2 = n1.build(2, "click")
    _, n3 = n2.build(3, "purchase")
    n3.set_state("BOUGHT")
    return master


def shop_automaton() -> Automaton:
    return shop().compile()


# ---------------------------------------------------------------------------------------------------------------------
# The trace of the events table
# ---------------------------------------------------------------------------------------------------------------------
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01', ts)")
    return e.select(
        F.lit("events").alias("source"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("lino"),
        F.col("user_id").cast("string").alias("target"),
        F.col("user_id").cast("string").alias("thread"),
        (F.col("user_id") % 4).cast("int").alias("host"),
        F.lit("app").alias("component"),
        F.when(F.col("user_id") % 2 == 0, "client").otherwise("server").alias("role"),
        F.col("event_type").alias("keyword"),
        us.alias("us"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        "event_id",
        "value",
    )


def paces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.paces(trace(spark, sf_dir), shop_automaton())


def _items(t: DataFrame, keyword: str) -> DataFrame:
    return t.where(F.col("keyword") == keyword).select(F.col("event_id").alias("pace_id"), "us", "k", "host", "thread", "role")


LINES = """
 lines AS (SELECT 'events' AS source, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lino,
   CAST(user_id AS VARCHAR) AS target, CAST(user_id AS VARCHAR) AS thread, CAST(user_id % 4 AS INTEGER) AS host,
   CASE WHEN user_id % 2 = 0 THEN 'client' ELSE 'server' END AS role, event_type AS keyword,
   epoch_us(ts) - 1704067200000000 AS us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id, value FROM events)"""

WALK = (
    LINES
    + """,
 walk AS (SELECT l.*, CASE WHEN keyword = 'view' THEN 1 ELSE 0 END AS s, CASE WHEN keyword = 'view' THEN 0 ELSE -1 END AS ti,
     CASE WHEN keyword = 'view' THEN 'start' ELSE 'dangling' END AS status, 0 AS s0 FROM lines l WHERE lino = 1
   UNION ALL
   SELECT l.*, CASE WHEN w.s = 1 AND l.keyword = 'click' THEN 2 WHEN w.s = 2 AND l.keyword = 'purchase' THEN 3 WHEN l.keyword = 'view' THEN 1 ELSE 0 END,
     w.ti + CASE WHEN l.keyword = 'view' THEN 1 ELSE 0 END,
     CASE WHEN w.s = 1 AND l.keyword = 'click' OR w.s = 2 AND l.keyword = 'purchase' THEN 'step' WHEN l.keyword = 'view' THEN 'start' ELSE 'dangling' END, w.s
   FROM walk w JOIN lines l ON l.thread = w.thread AND l.lino = w.lino + 1),
 paces AS (SELECT *, 'events#' || target || '#' || thread || '#' || ti AS ti_id, 'events#' || target || '#' || thread || '#' || lino AS pace_id,
     'e' || s AS edge, 'n' || s AS to_node, row_number() OVER (PARTITION BY thread, ti ORDER BY lino) - 1 AS seq
   FROM walk WHERE status <> 'dangling'),
 insts AS (SELECT ti_id, target, thread, host, count(*) AS n_paces, min(us) AS from_us, max(us) AS to_us, max(s) = 3 AS is_complete
   FROM paces GROUP BY ti_id, target, thread, host),
 ints AS (SELECT *, to_us - us AS lapse, edge || '[' || to_node || ']' || to_edge AS path FROM (
   SELECT *, lead(us) OVER w AS to_us, lead(edge) OVER w AS to_edge FROM paces WINDOW w AS (PARTITION BY ti_id ORDER BY seq)) WHERE to_us IS NOT NULL)"""
)


def _zip(a: str, b: str, key: str = "k") -> str:
    return f"""
 f AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY us, event_id) AS rn FROM lines WHERE keyword = '{a}'),
 t AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY us, event_id) AS rn FROM lines WHERE keyword = '{b}'),
 linked AS (SELECT f.event_id AS from_id, t.event_id AS to_id, f.us AS from_us, t.us AS to_us, f.host AS from_host, t.host AS to_host FROM f JOIN t ON f.{key} = t.{key} AND f.rn = t.rn)"""


def _linked(spark: SparkSession, sf_dir: str, strategy: str = "ONE", a: str = "view", b: str = "click") -> DataFrame:
    t = trace(spark, sf_dir)
    return links.link(_items(t, a), _items(t, b), ["k"], strategy)


# -- scans, checks ----------------------------------------------------------------------------------------------------
@query(f"WITH {LINES} SELECT thread, lino, keyword, us FROM lines WHERE keyword IN ('view', 'click') AND value > 50")
def line_scan_filter(spark, sf_dir):
    return trace(spark, sf_dir).where("keyword in ('view', 'click') and value > 50").select("thread", "lino", "keyword", "us")


@query(
    f"""WITH {LINES}, per AS (SELECT role AS component, target, host, count(DISTINCT thread) AS threads, count(*) AS lines FROM lines GROUP BY ALL)
 SELECT component, count(DISTINCT target) AS targets, count(DISTINCT host) AS hosts, CAST(sum(threads) AS BIGINT) AS threads,
 CAST(sum(lines) AS BIGINT) AS lines, avg(lines) AS mean_lines, min(lines) AS min_lines, max(lines) AS max_lines FROM per GROUP BY component"""
)
def component_summary(spark, sf_dir):
    return tracelog.component_summary(trace(spark, sf_dir).withColumn("component", F.col("role")))


@query(
    f"""WITH {LINES} SELECT event_id, CASE WHEN keyword = 'error' THEN 'keyword,time' WHEN value < 10 THEN 'time' ELSE '' END AS missing
 FROM lines WHERE keyword = 'error' OR value < 10"""
)
def line_validation(spark, sf_dir):
    t = trace(spark, sf_dir).withColumn("seconds", F.col("us") / 1e6)
    t = t.withColumn("time", F.when((F.col("keyword") != "error") & (F.col("value") >= 10), F.col("us").cast("string"))).withColumn("keyword", F.when(F.col("keyword") != "error", F.col("keyword")))
    return tracelog.check_lines(t).where(F.size("missing") > 0).select("event_id", F.array_join("missing", ",").alias("missing"))


@query("SELECT CAST(CAST(value AS INTEGER) % 50 AS VARCHAR) AS target, count(DISTINCT user_id % 4) AS hosts, count(DISTINCT user_id % 2) AS components FROM events GROUP BY 1 HAVING count(DISTINCT user_id % 4) > 1 OR count(DISTINCT user_id % 2) > 1")
def target_invariants(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    x = e.select((F.round("value").cast("int") % 50).cast("string").alias("target"), (F.col("user_id") % 4).alias("host"), (F.col("user_id") % 2).alias("component"))
    return tracelog.check_targets(x)


@query(
    f"""WITH {LINES}, x AS (SELECT thread AS source, lino, target, CASE WHEN k % 3 > 0 THEN 'a' || target END AS target_alias FROM lines),
 y AS (SELECT *, first_value(target_alias IS NOT NULL) OVER (PARTITION BY source ORDER BY lino) AS has FROM x)
 SELECT source, lino, CASE WHEN has THEN target_alias ELSE target END AS alias, (target_alias IS NOT NULL) = has AS alias_ok FROM y"""
)
def alias_policy(spark, sf_dir):
    t = trace(spark, sf_dir).select(F.col("thread").alias("source"), "lino", "target", F.when(F.col("k") % 3 > 0, F.concat(F.lit("a"), "target")).alias("target_alias"))
    return tracelog.with_alias(t).select("source", "lino", "alias", "alias_ok")


def _log(t: DataFrame) -> DataFrame:
    """Log lines in the bundled format, made of the events."""
    clock_ = F.format_string("%02d:%02d:%02d.%06d", F.expr("(us div 3600000000) % 24"), F.expr("(us div 60000000) % 60"), F.expr("(us div 1000000) % 60"), F.expr("us % 1000000"))
    line = F.concat(
        F.lit("["), clock_, F.lit("] (+0.000001) h"), F.col("host").cast("string"), F.lit(":fio:"), F.col("thread"), F.lit(" shop:"), F.col("keyword"),
        F.lit(": { cpu_id = 0 }, { pthread_id = "), F.col("thread"), F.lit(" }, { k = "), F.col("k").cast("string"), F.lit(", target = "), F.col("event_id").cast("string"), F.lit(" }"),
    )
    return t.select(F.concat(F.lit("h"), F.col("host").cast("string")).alias("source"), F.col("event_id").alias("lino"), line.alias("line"))


@query(
    f"""WITH {LINES} SELECT 'h' || host AS host, event_id AS lino, 'app' AS component, 'fio:' || thread AS target, thread, keyword,
 CAST(k AS VARCHAR) AS k, CAST(event_id AS VARCHAR) AS target_a, round(((us // 1000000) % 86400) + (us % 1000000) / 1000000.0, 6) AS seconds FROM lines"""
)
def log_line_parse(spark, sf_dir):
    got = tracelog.parse(_log(trace(spark, sf_dir)), "shop", {"fio": "app"}, rename={"target": "target_a"})
    at = lambda k: F.element_at("vars", F.lit(k)).alias(k)
    return got.select("host", "lino", "component", "target", "thread", "keyword", at("k"), at("target_a"), F.round("seconds", 6).alias("seconds"))


@query(f"WITH {LINES} SELECT event_id, CAST(k AS VARCHAR) AS k, keyword AS kw FROM lines")
def kv_parse(spark, sf_dir):
    body = F.concat(F.lit("k="), F.col("k").cast("string"), F.lit(",kw="), "keyword", F.lit(",none="))
    v = trace(spark, sf_dir).select("event_id", tracelog.key_values(body, spaced=False).alias("v"))
    return v.select("event_id", F.element_at("v", "k").alias("k"), F.element_at("v", "kw").alias("kw"))


@query(f"WITH {LINES} SELECT event_id, list_aggregate(list_sort(list_intersect(['k', keyword], ['view', 'k'])), 'string_agg', ',') AS clash FROM lines")
def key_conflicts(spark, sf_dir):
    both = F.array_intersect(F.array(F.lit("k"), F.col("keyword")), F.array(F.lit("view"), F.lit("k")))
    return trace(spark, sf_dir).select("event_id", F.array_join(F.sort_array(both), ",").alias("clash"))


# -- automaton --------------------------------------------------------------------------------------------------------
@query(f"WITH RECURSIVE {WALK} SELECT thread, lino, status, CASE WHEN status <> 'dangling' THEN ti END AS ti, CASE WHEN status <> 'dangling' THEN 'e' || s END AS edge FROM walk")
def automaton_steps(spark, sf_dir):
    return A.segment(trace(spark, sf_dir), shop_automaton()).select("thread", "lino", "status", "ti", "edge")


@query(f"WITH RECURSIVE {WALK} SELECT ti_id, thread, n_paces, from_us, to_us, is_complete FROM insts")
def automaton_instances(spark, sf_dir):
    return A.instances(paces(spark, sf_dir)).select("ti_id", "thread", "n_paces", "from_us", "to_us", "is_complete")


@query(
    f"""WITH RECURSIVE {WALK}, f AS (SELECT *, status = 'dangling' AND coalesce(lag(status) OVER (PARTITION BY thread ORDER BY lino), '') <> 'dangling' AS first FROM walk),
 r AS (SELECT *, max(CASE WHEN first THEN lino END) OVER (PARTITION BY thread ORDER BY lino) AS run FROM f),
 bad AS (SELECT thread, lino AS run, s0, keyword, lino, TRUE AS err FROM r WHERE status = 'start' AND s0 IN (1, 2)
  UNION ALL SELECT d.thread, d.run, c.s0, c.keyword, d.lino, d.first FROM r d JOIN r c ON c.thread = d.thread AND c.lino = d.run WHERE d.status = 'dangling')
 SELECT CASE WHEN s0 = 0 THEN 'thread start' ELSE 'e' || s0 || '->n' || s0 END AS position, keyword, count(*) FILTER (err) AS errors, count(*) AS affected, min(lino) FILTER (err) AS first_lino
 FROM bad GROUP BY 1, 2"""
)
def automaton_dangling_digest(spark, sf_dir):
    return A.error_digest(A.segment(trace(spark, sf_dir), shop_automaton()))


@query(
    f"""WITH RECURSIVE {WALK} SELECT path, count(*) AS n, CAST(sum(lapse) AS BIGINT) AS total, avg(lapse) AS mean,
 CAST(sum(lapse) AS DOUBLE) / sum(sum(lapse)) OVER () AS share FROM ints GROUP BY path"""
)
def thread_intervals_by_path(spark, sf_dir):
    return stats.totals(stats.thread_intervals(paces(spark, sf_dir)), "path", "lapse")


@query(f"WITH RECURSIVE {WALK} SELECT e.edge FROM (VALUES ('e1'), ('e2'), ('e3'), ('e4')) e(edge) WHERE e.edge NOT IN (SELECT edge FROM paces)")
def unseen_edges(spark, sf_dir):
    declared = spark.createDataFrame([(e.name,) for e in shop().iter_edges()] + [("e4",)], "edge string")
    return A.coverage(paces(spark, sf_dir), declared)


@query(
    f"""WITH RECURSIVE {WALK} SELECT ti_id, CASE WHEN count(DISTINCT k) = 1 THEN CAST(min(k) AS VARCHAR) END AS single, count(DISTINCT k) AS n_values
 FROM paces GROUP BY ti_id"""
)
def var_folding(spark, sf_dir):
    v = paces(spark, sf_dir).select("ti_id", F.lit("k").alias("key"), F.col("k").cast("string").alias("value"))
    got = variables.fold(v, "ti_id", "key", "value")
    return got.select("ti_id", "single", F.coalesce(F.size("several"), F.lit(1)).cast("long").alias("n_values"))


@query(
    f"""WITH {LINES}, x AS (SELECT event_id, k, sum(CASE WHEN keyword = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY target, k ORDER BY lino ROWS UNBOUNDED PRECEDING) AS cnt,
 max(CASE WHEN keyword = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY target ORDER BY lino ROWS UNBOUNDED PRECEDING) AS seen FROM lines)
 SELECT event_id, CASE WHEN seen = 1 THEN CAST(cnt AS BIGINT) || ':' || k ELSE CAST(k AS VARCHAR) END AS versioned FROM x"""
)
def refresh_version(spark, sf_dir):
    t = trace(spark, sf_dir).withColumn("key", F.lit("k")).withColumn("v", F.col("k").cast("string"))
    return variables.refresh(t, "target", ["lino"], "key", "v", F.col("keyword") == "signup").select("event_id", "versioned")


@query(f"WITH RECURSIVE {WALK} SELECT p.pace_id, CAST(coalesce(CASE WHEN p.k % 2 = 0 THEN p.k END, m.least) AS VARCHAR) AS k FROM paces p JOIN (SELECT ti_id, min(k) AS least FROM paces GROUP BY ti_id) m USING (ti_id)")
def env_lookup(spark, sf_dir):
    p = paces(spark, sf_dir)
    own = F.when(F.col("k") % 2 == 0, F.create_map(F.lit("k"), F.col("k").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    ti = p.groupBy("ti_id").agg(F.create_map(F.lit("k"), F.min("k").cast("string")).alias("ti_vars"))
    return p.withColumn("vars", own).join(ti, "ti_id").select("pace_id", variables.lookup("k").alias("k"))


@query(
    f"""WITH RECURSIVE {WALK}, v AS (SELECT ti_id, 'k' AS key, CAST(k AS VARCHAR) AS value FROM paces UNION ALL SELECT ti_id, 'host', CAST(host AS VARCHAR) FROM paces),
 per AS (SELECT ti_id, key, count(DISTINCT value) AS n, min(value) AS value FROM v GROUP BY ALL)
 SELECT ti_id, key, value FROM per WHERE key IN (SELECT key FROM per GROUP BY key HAVING max(n) = 1)"""
)
def request_vars_single(spark, sf_dir):
    p = paces(spark, sf_dir)
    v = p.select("ti_id", F.explode(F.create_map(F.lit("k"), F.col("k").cast("string"), F.lit("host"), F.col("host").cast("string"))).alias("key", "value"))
    return variables.single_valued(v, "ti_id", "key", "value")


# -- links ------------------------------------------------------------------------------------------------------------
@query(f"WITH {LINES},{_zip('view', 'click')} SELECT from_id, to_id, to_us - from_us AS lapse FROM linked")
def link_one_fifo(spark, sf_dir):
    return _linked(spark, sf_dir).select("from_id", "to_id", (F.col("to_us") - F.col("from_us")).alias("lapse"))


@query(f"WITH {LINES},{_zip('view', 'purchase')} SELECT from_id, to_id FROM linked")
def link_all(spark, sf_dir):
    return _linked(spark, sf_dir, "ALL", "view", "purchase").select("from_id", "to_id")


@query(f"WITH {LINES},{_zip('view', 'click')} SELECT f.event_id AS from_id, t.event_id AS to_id FROM t JOIN f ON f.k = t.k AND f.rn = 1")
def link_any(spark, sf_dir):
    return _linked(spark, sf_dir, "ANY").select("from_id", "to_id")


@query(
    f"""WITH {LINES},{_zip('view', 'click')}, f2 AS (SELECT event_id, host, row_number() OVER (PARTITION BY host ORDER BY us, event_id) AS rn FROM lines WHERE keyword = 'view' AND event_id NOT IN (SELECT from_id FROM linked)),
 t2 AS (SELECT event_id, host, row_number() OVER (PARTITION BY host ORDER BY us, event_id) AS rn FROM lines WHERE keyword = 'purchase')
 SELECT 'by_k' AS rule, from_id, to_id FROM linked UNION ALL SELECT 'by_host', f2.event_id, t2.event_id FROM f2 JOIN t2 ON f2.host = t2.host AND f2.rn = t2.rn"""
)
def link_two_rules_consumed(spark, sf_dir):
    t = trace(spark, sf_dir)
    sides = {k: _items(t, k) for k in ("view", "click", "purchase")}
    rules = [{"name": "by_k", "from": "view", "to": "click", "key": ["k"], "strategy": "ONE"}, {"name": "by_host", "from": "view", "to": "purchase", "key": ["host"], "strategy": "ONE"}]
    return links.link_rules(rules, sides, sides).select("rule", "from_id", "to_id")


@query(f"WITH {LINES},{_zip('view', 'click')} SELECT 'from' AS side, event_id AS pace_id FROM f WHERE event_id NOT IN (SELECT from_id FROM linked) UNION ALL SELECT 'to', event_id FROM t WHERE event_id NOT IN (SELECT to_id FROM linked)")
def link_misses(spark, sf_dir):
    t = trace(spark, sf_dir)
    got = _linked(spark, sf_dir)
    a, b = links.misses(_items(t, "view"), got, "from"), links.misses(_items(t, "click"), got, "to")
    return a.select(F.lit("from").alias("side"), "pace_id").unionAll(b.select(F.lit("to").alias("side"), "pace_id"))


@query(
    f"""WITH {LINES},{_zip('view', 'click')}, d AS (SELECT count(*) AS n_links, count(*) FILTER (to_us < from_us) AS n_negative, max(from_us - to_us) FILTER (to_us < from_us) AS max_negative_us FROM linked)
 SELECT d.*, a.n AS n_from, b.n AS n_to, a.n - n_links AS from_missed, b.n - n_links AS to_missed FROM d, (SELECT count(*) AS n FROM f) a, (SELECT count(*) AS n FROM t) b"""
)
def link_diagnostics(spark, sf_dir):
    t = trace(spark, sf_dir)
    return links.diagnostics(_items(t, "view"), _items(t, "click"), _linked(spark, sf_dir))


@query(f"WITH {LINES},{_zip('view', 'click')} SELECT from_id, to_id, from_us - to_us AS early FROM linked WHERE from_us > to_us")
def negative_offsets(spark, sf_dir):
    return clock.violations(_linked(spark, sf_dir)).select("from_id", "to_id", (F.col("from_us") - F.col("to_us")).alias("early"))


def _hosted(spark, sf_dir) -> DataFrame:
    t = trace(spark, sf_dir)
    h = t.select("event_id", "host")
    got = links.link(_items(t, "view"), _items(t, "click"), ["k"])
    got = got.join(h.select(F.col("event_id").alias("from_id"), F.col("host").alias("from_host")), "from_id")
    return got.join(h.select(F.col("event_id").alias("to_id"), F.col("host").alias("to_host")), "to_id")


@query(f"WITH {LINES},{_zip('view', 'click')} SELECT CASE WHEN from_host <> to_host THEN 'remote' ELSE 'local_remote' END AS remote_type, count(*) AS n FROM linked GROUP BY 1")
def remote_type_counts(spark, sf_dir):
    got = _hosted(spark, sf_dir)
    return got.groupBy(links.remote_type(F.lit(True), F.col("from_host"), F.col("to_host")).alias("remote_type")).agg(F.count("*").alias("n"))


@query(f"WITH {LINES},{_zip('view', 'click')} SELECT from_id, count(*) AS links, count(*) = 1 AS success FROM linked GROUP BY from_id")
def strategy_success(spark, sf_dir):
    return links.success(_linked(spark, sf_dir).withColumn("rule", F.lit("r")), "ALL", ["r"])


@query(
    f"""WITH {LINES},{_zip('view', 'click')}, g AS (SELECT event_id, us, row_number() OVER (PARTITION BY k ORDER BY us, event_id) AS rn, k FROM lines WHERE keyword = 'signup'),
 e AS (SELECT event_id, us, row_number() OVER (PARTITION BY k ORDER BY us, event_id) AS rn, k FROM lines WHERE keyword = 'error'),
 n AS (SELECT f.event_id AS fi, f.us AS fu, g.event_id AS gi, g.us AS gu, e.event_id AS ei, e.us AS eu, t.event_id AS tid, t.us AS tu
   FROM f JOIN t ON f.k = t.k AND f.rn = t.rn JOIN g ON g.k = f.k AND g.rn = f.rn JOIN e ON e.k = t.k AND e.rn = t.rn)
 SELECT fi AS request_from, 'enter' AS kind, fi AS a, fu AS a_us, gi AS b, gu AS b_us FROM n UNION ALL
 SELECT fi, 'nested', gi, gu, ei, eu FROM n UNION ALL SELECT fi, 'leave', ei, eu, tid, tu FROM n"""
)
def request_nesting(spark, sf_dir):
    t = trace(spark, sf_dir)
    main = links.link(_items(t, "view"), _items(t, "click"), ["k"])
    entering, leaving = links.link(_items(t, "view"), _items(t, "signup"), ["k"]), links.link(_items(t, "error"), _items(t, "click"), ["k"])
    return links.nest(main, entering, leaving)


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dimension_join(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    return c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(r, F.col("n_regionkey") == r["r_regionkey"], "left").select("c_custkey", "n_name", "r_name")


@query(
    f"""WITH {LINES},{_zip('view', 'click')}, x AS (SELECT 'from' AS side, a.event_id, b.n AS met, l.from_id IS NOT NULL AS linked
   FROM (SELECT * FROM lines WHERE keyword = 'view') a LEFT JOIN (SELECT k, count(*) AS n FROM lines WHERE keyword = 'click' GROUP BY k) b USING (k) LEFT JOIN linked l ON l.from_id = a.event_id
  UNION ALL SELECT 'to', a.event_id, b.n, l.to_id IS NOT NULL FROM (SELECT * FROM lines WHERE keyword = 'click') a LEFT JOIN (SELECT k, count(*) AS n FROM lines WHERE keyword = 'view' GROUP BY k) b USING (k) LEFT JOIN linked l ON l.to_id = a.event_id)
 SELECT side, count(*) FILTER (met IS NULL) AS nomatch, count(*) FILTER (met > 0 AND NOT linked) AS novalidmatch, count(*) FILTER (met > 1) AS multi, max(met) FILTER (met > 1) AS most, avg(met) FILTER (met > 1) AS mean FROM x GROUP BY side"""
)
def match_diagnostics(spark, sf_dir):
    t = trace(spark, sf_dir)
    return links.match_diagnostics(_items(t, "view"), _items(t, "click"), _linked(spark, sf_dir), ["k"])


@query(
    f"""WITH {LINES},{_zip('view', 'click')}, n AS (SELECT k, count(*) FILTER (keyword = 'view') AS f, count(*) FILTER (keyword = 'click') AS t FROM lines GROUP BY k)
 SELECT k, side, pace_id, us, linked FROM (SELECT k, CASE keyword WHEN 'view' THEN 'from' ELSE 'to' END AS side, event_id AS pace_id, us, event_id IN (SELECT from_id FROM linked UNION ALL SELECT to_id FROM linked) AS linked
   FROM lines JOIN n USING (k) WHERE keyword IN ('view', 'click') AND f > 0 AND t > 0 AND f + t > 2) ORDER BY us, side, pace_id LIMIT 20"""
)
def ambiguous_matches(spark, sf_dir):
    t = trace(spark, sf_dir)
    return links.ambiguous(_items(t, "view"), _items(t, "click"), _linked(spark, sf_dir), ["k"])


# -- requests ---------------------------------------------------------------------------------------------------------
def _ti_links(p: DataFrame) -> DataFrame:
    """Clicks linked to instances' views with the same k, first in first out: instance to instance."""
    f = p.where("edge = 'e2'").select("pace_id", "us", "k", "ti_id")
    t = p.where("edge = 'e1'").select("pace_id", "us", "k", "ti_id")
    got = links.link(f, t, ["k"])
    got = got.join(f.select(F.col("pace_id").alias("from_id"), F.col("ti_id").alias("from_ti")), "from_id")
    return got.join(t.select(F.col("pace_id").alias("to_id"), F.col("ti_id").alias("to_ti")), "to_id")


TI_LINKS = (
    WALK
    + """,
 pf AS (SELECT pace_id, us, k, ti_id, row_number() OVER (PARTITION BY k ORDER BY us, pace_id) AS rn FROM paces WHERE edge = 'e2'),
 pt AS (SELECT pace_id, us, k, ti_id, row_number() OVER (PARTITION BY k ORDER BY us, pace_id) AS rn FROM paces WHERE edge = 'e1'),
 tl AS (SELECT pf.pace_id AS from_id, pt.pace_id AS to_id, pf.ti_id AS from_ti, pt.ti_id AS to_ti FROM pf JOIN pt USING (k, rn)),
 nb AS (SELECT from_ti AS a, to_ti AS b FROM tl UNION SELECT to_ti, from_ti FROM tl),
 reach AS (SELECT ti_id AS n, ti_id AS m FROM insts UNION SELECT r.n, nb.b FROM reach r JOIN nb ON nb.a = r.m),
 grp AS (SELECT n AS ti_id, min(m) AS group_id FROM reach GROUP BY n)"""
)


def _grouped(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = paces(spark, sf_dir)
    got = _ti_links(p)
    return p, got, requests.groups(A.instances(p).select("ti_id"), got.select("from_ti", "to_ti"))


@query(f"WITH RECURSIVE {TI_LINKS} SELECT ti_id, group_id FROM grp")
def connected_components(spark, sf_dir):
    return _grouped(spark, sf_dir)[2]


_BUILT = """SELECT group_id, 'purchase' AS request_type, CASE WHEN bool_or(is_complete) THEN 'BOUGHT' END AS request_state,
 count(*) AS len_threadinss, CAST(sum(n_paces - 1) AS BIGINT) AS len_paces, count(DISTINCT thread) AS len_threads, min(from_us) AS from_us, max(to_us) AS last_us,
 CASE WHEN count(*) > 1 THEN 'several starts' WHEN count(*) FILTER (is_complete) = 0 THEN 'no end,incomplete' ELSE '' END AS errors
 FROM insts JOIN grp USING (ti_id) GROUP BY group_id"""


def _built(spark, sf_dir) -> DataFrame:
    p, got, group_of = _grouped(spark, sf_dir)
    inst = A.instances(p).join(p.groupBy("ti_id").agg(F.min("host").alias("host")), "ti_id")
    return requests.build(requests.members(inst, group_of, got))


@query(f"WITH RECURSIVE {TI_LINKS} {_BUILT}")
def request_build(spark, sf_dir):
    cols = ["group_id", "request_type", "request_state", "len_threadinss", "len_paces", "len_threads", "from_us", "last_us"]
    return _built(spark, sf_dir).select(*cols, F.array_join("errors", ",").alias("errors"))


@query(f"WITH RECURSIVE {TI_LINKS} SELECT errors, count(*) AS n FROM ({_BUILT}) GROUP BY errors")
def request_errors(spark, sf_dir):
    return _built(spark, sf_dir).groupBy(F.array_join("errors", ",").alias("errors")).agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {WALK} SELECT ti_id, 'purchase' || row_number() OVER (ORDER BY from_us, ti_id) AS request FROM insts WHERE is_complete")
def auto_names(spark, sf_dir):
    done = A.instances(paces(spark, sf_dir)).where("is_complete").withColumnRenamed("ti_id", "group_id")
    return requests.auto_names(done).select(F.col("group_id").alias("ti_id"), "request")


def _main(spark, sf_dir) -> DataFrame:
    """Main paths of the linked groups."""
    p, got, group_of = _grouped(spark, sf_dir)
    p = p.join(group_of, "ti_id").withColumn("is_start", F.col("edge") == "e1").withColumn("is_end", F.col("edge") == "e3")
    return requests.main_paths(p, got)[0]


MAIN = (
    TI_LINKS
    + """,
 ends AS (SELECT group_id, min(pace_id) AS pid FROM paces JOIN grp USING (ti_id) WHERE s = 3 GROUP BY group_id HAVING count(*) = 1),
 pr AS (SELECT p.pace_id, coalesce(l.from_id, p.before) AS prev, CASE WHEN l.from_id IS NULL THEN 'thread' ELSE 'link' END AS kind
   FROM (SELECT pace_id, lag(pace_id) OVER (PARTITION BY ti_id ORDER BY seq) AS before FROM paces) p LEFT JOIN tl l ON l.to_id = p.pace_id),
 mp AS (SELECT group_id, pid AS node, 0 AS step FROM ends UNION ALL SELECT group_id, pr.prev, step + 1 FROM mp JOIN pr ON pr.pace_id = mp.node WHERE pr.prev IS NOT NULL AND step < 500),
 main AS (SELECT group_id, CAST(max(step) OVER (PARTITION BY group_id) - 1 - step AS INTEGER) AS pos, kind, prev AS from_id, node AS to_id
   FROM mp JOIN pr ON pr.pace_id = mp.node WHERE group_id NOT IN (SELECT group_id FROM mp WHERE step = 500))"""
)


@query(f"WITH RECURSIVE {MAIN} SELECT group_id, pos, kind, from_id, to_id FROM main WHERE from_id IS NOT NULL")
def main_path(spark, sf_dir):
    return _main(spark, sf_dir)


def _intervals(spark, sf_dir) -> DataFrame:
    return stats.thread_intervals(paces(spark, sf_dir))


@query(f"WITH RECURSIVE {WALK} SELECT pace_id, row_number() OVER (PARTITION BY thread, path ORDER BY us) AS \"order\" FROM ints")
def path_order(spark, sf_dir):
    return requests.occurrence(_intervals(spark, sf_dir), ["thread", "path"], ["us"]).select("pace_id", "order")


# -- clocks -----------------------------------------------------------------------------------------------------------
_SKEWED = """skewed AS (SELECT from_host, to_host, to_us - from_us + (from_host - to_host) * 864000000000 AS lapse FROM linked WHERE to_us > from_us AND from_host <> to_host)"""


def _skewed(spark, sf_dir) -> DataFrame:
    """Forward links whose hosts' clocks are off by ten days a host number."""
    got = _hosted(spark, sf_dir).where("to_us > from_us and from_host <> to_host")
    skew = (F.col("from_host") - F.col("to_host")) * F.lit(864_000_000_000)
    return got.withColumn("to_us", F.col("to_us") + skew)


@query(
    f"""WITH {LINES},{_zip('view', 'click')}, {_SKEWED} SELECT least(from_host, to_host) AS host_a, greatest(from_host, to_host) AS host_b,
 max(-lapse) FILTER (from_host > to_host) AS low, min(lapse) FILTER (from_host < to_host) AS high FROM skewed GROUP BY 1, 2"""
)
def clock_pair_bounds(spark, sf_dir):
    return clock.pair_bounds(_skewed(spark, sf_dir))


@query(
    f"""WITH {LINES},{_zip('view', 'click')}, {_SKEWED}, b AS (SELECT least(from_host, to_host) AS host_a, greatest(from_host, to_host) AS host_b,
 max(-lapse) FILTER (from_host > to_host) AS low, min(lapse) FILTER (from_host < to_host) AS high FROM skewed GROUP BY 1, 2) SELECT * FROM b WHERE low > 0 OR high < 0"""
)
def clock_violated_pairs(spark, sf_dir):
    return clock.violated_pairs(clock.pair_bounds(_skewed(spark, sf_dir)))


@query(
    f"""WITH {LINES},{_zip('view', 'click')}, {_SKEWED}, b AS (SELECT max(-lapse) FILTER (from_host > to_host) AS low, min(lapse) FILTER (from_host < to_host) AS high FROM skewed WHERE from_host + to_host = 1)
 SELECT '0' AS host, 0.0::DOUBLE AS "offset" UNION ALL SELECT '1', -(low + high) / 2.0 FROM b"""
)
def clock_offsets_two_hosts(spark, sf_dir):
    """Two hosts bounded on both sides: the first stands at 0, the other in the middle of its range."""
    return clock.offsets(_skewed(spark, sf_dir).where("from_host + to_host = 1"))


@query("SELECT CAST(0 AS BIGINT) AS violated, TRUE AS violated_before")
def clock_post_check(spark, sf_dir):
    x = _skewed(spark, sf_dir)
    before = clock.violated_pairs(clock.pair_bounds(x)).agg(F.count("*")).scalar()
    return clock.still_violated(x, clock.offsets(x)).agg(F.count("*").alias("violated")).withColumn("violated_before", before > 0)


@query(f"WITH {LINES} SELECT event_id, us - (SELECT min(us) FROM lines WHERE keyword = 'view') AS us FROM lines")
def zero_base(spark, sf_dir):
    return clock.zero_base(trace(spark, sf_dir), F.when(F.col("keyword") == "view", F.col("us"))).select("event_id", "us")


# -- statistics -------------------------------------------------------------------------------------------------------
_FIVE = "count({0}) AS n, min({0}) AS lo, quantile_cont({0}, 0.25) AS p25, quantile_cont({0}, 0.5) AS p50, quantile_cont({0}, 0.75) AS p75, max({0}) AS hi"


@query(f"SELECT o_orderpriority, n, lo, round(p25, 4) AS p25, round(p50, 4) AS p50, round(p75, 4) AS p75, hi FROM (SELECT o_orderpriority, {_FIVE.format('o_totalprice')} FROM orders GROUP BY o_orderpriority)")
def dist_summary(spark, sf_dir):
    got = stats.five_numbers(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")
    return got.withColumns({c: F.round(c, 4) for c in ("p25", "p50", "p75")})


@query(f"WITH RECURSIVE {WALK} SELECT path, {_FIVE.format('lapse')} FROM ints GROUP BY path")
def lapse_by_dimension(spark, sf_dir):
    return Intervals(_intervals(spark, sf_dir)).lapse_by("path")


@query(f"WITH RECURSIVE {WALK} SELECT host, quantile_cont(lapse, 0.5) AS median, count(*) AS n FROM ints GROUP BY host ORDER BY median DESC, host LIMIT 2")
def slowest_paths_topk(spark, sf_dir):
    return stats.top_by_median(_intervals(spark, sf_dir), "host", "lapse", 2)


def _orders_as_intervals(spark, sf_dir) -> DataFrame:
    """A line item is an interval from its order's date to its ship date, on the host of its supplier."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    x = li.select("l_orderkey", "l_returnflag", "l_suppkey", day("l_shipdate").alias("s")).join(o.select(F.col("o_orderkey").alias("l_orderkey"), day("o_orderdate").alias("o")), "l_orderkey")
    return x.select((F.col("l_suppkey") % 8).cast("int").alias("host"), F.col("l_returnflag").alias("flag"), F.least("s", "o").alias("from_us"), F.greatest("s", "o").alias("to_us"))


SPANS = """iv AS (SELECT CAST(l_suppkey % 8 AS INTEGER) AS host, l_returnflag AS flag, least(o, s) AS from_us, greatest(o, s) AS to_us FROM (
 SELECT l_suppkey, l_returnflag, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS s, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS o
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""


@query(
    f"""WITH {SPANS}, m AS (SELECT *, max(to_us) OVER (PARTITION BY host, flag ORDER BY from_us, to_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM iv)
 SELECT host, flag, CAST(sum(greatest(0, to_us - greatest(from_us, coalesce(pm, from_us)))) AS BIGINT) AS busy, CAST(sum(to_us - from_us) AS BIGINT) AS added,
 CAST(sum(to_us - from_us) AS DOUBLE) / sum(greatest(0, to_us - greatest(from_us, coalesce(pm, from_us)))) AS concurrency FROM m GROUP BY host, flag"""
)
def projection_by_key(spark, sf_dir):
    return stats.union_measure(_orders_as_intervals(spark, sf_dir), ["host", "flag"])


_STEPS = f"""{SPANS}, d AS (SELECT host, x, CAST(sum(d) AS BIGINT) AS d FROM (SELECT host, from_us AS x, 1 AS d FROM iv UNION ALL SELECT host, to_us, -1 FROM iv) GROUP BY host, x HAVING sum(d) <> 0),
 st AS (SELECT host, x, CAST(sum(d) OVER (PARTITION BY host ORDER BY x) AS BIGINT) AS level FROM d)"""


@query(f"WITH {_STEPS} SELECT host, x, level FROM st")
def concurrency_steps(spark, sf_dir):
    return stats.steps(_orders_as_intervals(spark, sf_dir), ["host"])


@query(
    f"""WITH {_STEPS}, g AS (SELECT x, host FROM (SELECT DISTINCT x FROM st), (SELECT DISTINCT host FROM st))
 SELECT g.host, g.x, coalesce(last_value(level IGNORE NULLS) OVER (PARTITION BY g.host ORDER BY g.x), 0) AS level FROM g LEFT JOIN st USING (host, x)"""
)
def aligned_steps(spark, sf_dir):
    return stats.aligned(stats.steps(_orders_as_intervals(spark, sf_dir), ["host"]), "host")


@query(f"WITH {LINES},{_zip('view', 'click')} SELECT from_host, count(*) FILTER (to_host = 0) AS \"0\", count(*) FILTER (to_host = 1) AS \"1\", count(*) FILTER (to_host = 2) AS \"2\", count(*) FILTER (to_host = 3) AS \"3\" FROM linked WHERE from_host <> to_host GROUP BY from_host")
def host_matrix(spark, sf_dir):
    return stats.matrix(_hosted(spark, sf_dir).where("from_host <> to_host"), "from_host", "to_host", [0, 1, 2, 3])


@query(
    f"""WITH {LINES},{_zip('view', 'click')}, per AS (SELECT from_host, to_host, count(*) AS n FROM linked GROUP BY ALL)
 SELECT from_host % 2 AS from_component, to_host % 2 AS to_component, avg(n) AS mean_links FROM per GROUP BY 1, 2"""
)
def component_matrix(spark, sf_dir):
    per = _hosted(spark, sf_dir).groupBy("from_host", "to_host").agg(F.count("*").alias("n"))
    return per.groupBy((F.col("from_host") % 2).alias("from_component"), (F.col("to_host") % 2).alias("to_component")).agg(F.avg("n").alias("mean_links"))


@query(f"WITH {LINES},{_zip('view', 'click')} SELECT from_host, to_host, count(*) AS n FROM linked WHERE from_host <> to_host GROUP BY CUBE (from_host, to_host)")
def matrix_margins(spark, sf_dir):
    return _hosted(spark, sf_dir).where("from_host <> to_host").cube("from_host", "to_host").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct FROM events GROUP BY event_type")
def value_counts_pct(spark, sf_dir):
    return stats.value_counts(table(spark, sf_dir, "events"), ["event_type"])


@query("SELECT CAST(CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 11 ELSE floor(value / 10) + 1 END AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1")
def histogram(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "events"), "value", 0, 100, 10)


@query(f"WITH RECURSIVE {WALK} SELECT CAST(lapse // 1000000000 AS BIGINT) AS lapse_bin, CAST(((us + to_us) // 2) // 1000000000000 AS BIGINT) AS time_bin, count(*) AS n FROM ints GROUP BY 1, 2")
def lapse_time_density(spark, sf_dir):
    x = _intervals(spark, sf_dir)
    return x.groupBy(F.expr("lapse div 1000000000").alias("lapse_bin"), F.expr("((from_us + to_us) div 2) div 1000000000000").alias("time_bin")).agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {WALK} SELECT thread, CAST(sum(to_us - from_us) AS BIGINT) AS busy FROM insts GROUP BY thread")
def thread_busy_time(spark, sf_dir):
    return A.instances(paces(spark, sf_dir)).groupBy("thread").agg(F.sum(F.col("to_us") - F.col("from_us")).alias("busy"))


@query(f"WITH {LINES} SELECT event_id, row_number() OVER (PARTITION BY thread, keyword ORDER BY lino) AS nth FROM lines")
def nth_occurrence(spark, sf_dir):
    return trace(spark, sf_dir).select("event_id", F.row_number().over(Window.partitionBy("thread", "keyword").orderBy("lino")).alias("nth"))


@query(
    f"""WITH RECURSIVE {WALK}, p AS (SELECT *, string_agg(to_edge, '>') OVER (PARTITION BY ti_id ORDER BY seq) AS prefix FROM ints)
 SELECT prefix, count(*) AS n, CAST(sum(lapse) AS BIGINT) AS total, CAST(len(string_split(prefix, '>')) AS INTEGER) AS depth FROM p GROUP BY prefix"""
)
def workflow_trie(spark, sf_dir):
    return workflow.trie(_intervals(spark, sf_dir), "ti_id", "seq")


@query("SELECT * FROM (VALUES ('a', 'a'), ('a>b', 'a>b'), ('c', 'c'), ('c>b', 'a>b'), ('c>b>d', 'c>b>d'), ('a>b>a', 'a>b>a')) t(prefix, merged)")
def workflow_fold(spark, sf_dir):
    """Two groups of one label become one; a third, whose merging would close a circle, stays."""
    return workflow.folded(spark.createDataFrame([("a", 5), ("a>b", 3), ("c", 2), ("c>b", 2), ("c>b>d", 1), ("a>b>a", 1)], "prefix string, n long"))


@query(f"WITH RECURSIVE {WALK} SELECT 'read' AS stage, 'lines' AS counter, count(*) AS n FROM lines UNION ALL SELECT 'build_t', 'paces', count(*) FROM paces UNION ALL SELECT 'build_t', 'instances', count(*) FROM insts UNION ALL SELECT 'build_t', 'dangling', count(*) FROM walk WHERE status = 'dangling'")
def stage_report(spark, sf_dir):
    t = trace(spark, sf_dir)
    s = A.segment(t, shop_automaton())
    one = s.agg(F.count("*").alias("lines"), F.count(F.when(F.col("status") != "dangling", 1)).alias("paces"), F.count(F.when(F.col("status") == "start", 1)).alias("instances"), F.count(F.when(F.col("status") == "dangling", 1)).alias("dangling"))
    rows = [F.struct(F.lit(st).alias("stage"), F.lit(c).alias("counter"), F.col(c).alias("n")) for st, c in (("read", "lines"), ("build_t", "paces"), ("build_t", "instances"), ("build_t", "dangling"))]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query(f"WITH RECURSIVE {WALK} SELECT 'thread' AS kind, count(*) AS n, CAST(sum(lapse) AS BIGINT) AS total FROM ints UNION ALL SELECT 'link', count(*), CAST(sum(pt.us - pf.us) AS BIGINT) FROM (SELECT us, k, row_number() OVER (PARTITION BY k ORDER BY us, pace_id) AS rn FROM paces WHERE edge = 'e2') pf JOIN (SELECT us, k, row_number() OVER (PARTITION BY k ORDER BY us, pace_id) AS rn FROM paces WHERE edge = 'e1') pt USING (k, rn)")
def interval_union_common(spark, sf_dir):
    p = paces(spark, sf_dir)
    joins = _ti_links(p).withColumn("lapse", F.col("to_us") - F.col("from_us"))
    got = Intervals.union(stats.thread_intervals(p).select("from_us", "to_us", "lapse"), joins.select("from_us", "to_us", "lapse"))
    return got.frame.groupBy("kind").agg(F.count("*").alias("n"), F.sum("lapse").alias("total"))


@query(
    f"""WITH RECURSIVE {MAIN}, i AS (SELECT CASE WHEN m.kind = 'thread' THEN a.role WHEN a.host = b.host THEN 'remote_l' ELSE 'remote_r' END AS part, b.us - a.us AS lapse
   FROM main m JOIN paces a ON a.pace_id = m.from_id JOIN paces b ON b.pace_id = m.to_id),
 w AS (SELECT sum(b.us - a.us) AS whole FROM (SELECT group_id, min_by(from_id, pos) AS f, max_by(to_id, pos) AS t FROM main WHERE from_id IS NOT NULL GROUP BY group_id) JOIN paces a ON a.pace_id = f JOIN paces b ON b.pace_id = t)
 SELECT 'purchase' AS request_type, part, CAST(sum(lapse) AS BIGINT) AS total, CAST(sum(lapse) AS DOUBLE) / (SELECT whole FROM w) AS share FROM i GROUP BY part"""
)
def mainpath_share(spark, sf_dir):
    p = paces(spark, sf_dir).select("pace_id", "us", "host", "role")
    end = lambda side: p.select(*[F.col(c).alias(f"{side}_{c}") for c in p.columns]).withColumnRenamed(f"{side}_pace_id", f"{side}_id")
    x = _main(spark, sf_dir).join(end("from"), "from_id").join(end("to"), "to_id")
    x = x.select("group_id", "pos", "kind", F.lit("purchase").alias("request_type"), F.lit(True).alias("is_main"), (F.col("to_us") - F.col("from_us")).alias("lapse"), F.col("from_role").alias("component"), F.lit("inner").alias("int_type"), links.remote_type(F.lit(True), F.col("from_host"), F.col("to_host")).alias("remote_type"), "from_us", "to_us")
    whole = x.groupBy("group_id", "request_type").agg((F.max_by("to_us", "pos") - F.min_by("from_us", "pos")).alias("lapse"))
    return report.share_of_main_path(x.where("kind = 'thread'"), x.where("kind = 'link'"), whole)


@query(f"WITH RECURSIVE {TI_LINKS} SELECT 'purchase' AS request_type, 'td' AS kind, count(*) AS n FROM ints UNION ALL SELECT 'purchase', 'innerjoin', count(*) FROM tl")
def kind_counts(spark, sf_dir):
    p = paces(spark, sf_dir)
    a, b = stats.thread_intervals(p).select(F.lit("thread").alias("int_type")), _ti_links(p).select(F.lit("inner").alias("int_type"))
    return report.kind_counts(a.unionAll(b).withColumn("request_type", F.lit("purchase")))


@query(f"WITH RECURSIVE {WALK} SELECT pace_id, lapse FROM ints WHERE path = 'e1[n1]e2'")
def filter_bypath(spark, sf_dir):
    return Intervals(_intervals(spark, sf_dir)).by_path("e1[n1]e2").frame.select("pace_id", "lapse")


@query(f"WITH RECURSIVE {WALK} SELECT pace_id, lapse FROM ints WHERE to_node = 'n2'")
def filter_byiname(spark, sf_dir):
    return Intervals(_intervals(spark, sf_dir)).by_iname("n2").frame.select("pace_id", "lapse")


@query(f"WITH RECURSIVE {WALK} SELECT pace_id, lapse FROM (SELECT *, row_number() OVER (PARTITION BY thread, path ORDER BY us) AS nth FROM ints) WHERE nth = 2")
def filter_byorder(spark, sf_dir):
    x = requests.occurrence(_intervals(spark, sf_dir), ["thread", "path"], ["us"])
    return Intervals(x).by_order(2).frame.select("pace_id", "lapse")


@query(f"WITH RECURSIVE {MAIN} SELECT pace_id, lapse FROM ints JOIN main m ON m.from_id = pace_id AND m.kind = 'thread'")
def mains(spark, sf_dir):
    main = _main(spark, sf_dir).where("kind = 'thread'").select(F.col("from_id").alias("pace_id"), F.lit(True).alias("is_main"))
    return Intervals(_intervals(spark, sf_dir).join(main, "pace_id", "left")).mains.frame.select("pace_id", "lapse")


@query(f"WITH RECURSIVE {WALK} SELECT DISTINCT path FROM ints")
def distinct_lists(spark, sf_dir):
    return Intervals(_intervals(spark, sf_dir)).paths()


def _requests(spark, sf_dir) -> Requests:
    done = A.instances(paces(spark, sf_dir)).where("is_complete")
    return Requests(done.select(F.col("ti_id").alias("request"), "from_us", F.col("to_us").alias("last_us"), F.col("n_paces").alias("len_paces")))


@query(f"WITH RECURSIVE {WALK} SELECT ti_id AS request, to_us - from_us AS lapse FROM insts WHERE is_complete ORDER BY lapse DESC, request LIMIT 1")
def req_longest(spark, sf_dir):
    return _requests(spark, sf_dir).longest().select("request", "lapse")


@query(f"WITH RECURSIVE {WALK} SELECT ti_id AS request, to_us - from_us AS lapse FROM insts WHERE is_complete ORDER BY lapse, request LIMIT 1")
def req_shortest(spark, sf_dir):
    return _requests(spark, sf_dir).shortest().select("request", "lapse")


@query(f"WITH RECURSIVE {WALK} SELECT ti_id AS request, n_paces AS len_paces FROM insts WHERE is_complete ORDER BY n_paces DESC, request LIMIT 1")
def req_most_complex(spark, sf_dir):
    return _requests(spark, sf_dir).most_complex().select("request", "len_paces")


@query(f"WITH RECURSIVE {WALK} SELECT ti_id AS request, n_paces AS len_paces FROM insts WHERE is_complete ORDER BY n_paces, request LIMIT 1")
def req_simplest(spark, sf_dir):
    return _requests(spark, sf_dir).simplest().select("request", "len_paces")


@query(f"WITH {LINES} SELECT host, component, target, thread, row_number() OVER (ORDER BY host, component, target, thread) AS y FROM (SELECT DISTINCT host, 'app' AS component, target, thread FROM lines)")
def thread_index(spark, sf_dir):
    return stats.dense_index(trace(spark, sf_dir), "host", ["component", "target", "thread"])


@query(
    f"""WITH RECURSIVE {WALK}, o AS (SELECT path, us AS from_us, to_us, CAST(row_number() OVER (PARTITION BY thread, path ORDER BY us, pace_id) - 1 AS INTEGER) AS layer FROM ints),
 r AS (SELECT *, row_number() OVER (PARTITION BY path, layer ORDER BY from_us) AS rf, row_number() OVER (PARTITION BY path, layer ORDER BY to_us) AS rt, max(layer) OVER (PARTITION BY path) AS top FROM o)
 SELECT 'occupied' AS band, path, layer, from_us, to_us FROM o
 UNION ALL SELECT 'blank', path, 0, 0, from_us FROM o WHERE layer = 0
 UNION ALL SELECT 'blank', p.path, CAST(p.layer + 1 AS INTEGER), p.to_us, coalesce(c.from_us, (SELECT max(to_us) FROM o)) FROM r p LEFT JOIN r c ON c.path = p.path AND c.layer = p.layer + 1 AND c.rf = p.rt WHERE p.layer < p.top"""
)
def profiling_bands(spark, sf_dir):
    return stats.padding(_intervals(spark, sf_dir), "path", "thread", "pace_id")


@query(
    f"""WITH RECURSIVE {WALK}, p AS (SELECT *, string_agg(to_edge, '>') OVER (PARTITION BY ti_id ORDER BY seq) AS prefix FROM ints),
 iv AS (SELECT CAST(len(string_split(prefix, '>')) AS INTEGER) AS depth, prefix, us AS from_us, to_us FROM p UNION ALL SELECT 0, '', 0, us FROM p WHERE seq = 0),
 d AS (SELECT depth, prefix, x, sum(d) AS d FROM (SELECT depth, prefix, from_us AS x, 1 AS d FROM iv UNION ALL SELECT depth, prefix, to_us, -1 FROM iv) GROUP BY depth, prefix, x HAVING sum(d) <> 0)
 SELECT depth, prefix, x, CAST(sum(d) OVER (PARTITION BY depth, prefix ORDER BY x) AS BIGINT) AS level FROM d"""
)
def workflow_bands(spark, sf_dir):
    return workflow.bands(_intervals(spark, sf_dir), "ti_id", "seq")


@query(f"WITH RECURSIVE {WALK} SELECT ti_id, CAST(dense_rank() OVER (PARTITION BY host ORDER BY thread) AS INTEGER) AS y, from_us, to_us FROM insts")
def gantt_rows(spark, sf_dir):
    inst = paces(spark, sf_dir).groupBy("ti_id", "host", "thread").agg(F.min("us").alias("from_us"), F.max("us").alias("to_us"))
    return inst.select("ti_id", F.dense_rank().over(Window.partitionBy("host").orderBy("thread")).alias("y"), "from_us", "to_us")


@query("SELECT 0 AS ord, 'components' AS key, '1' AS value UNION ALL SELECT 1, 'edges', '3' UNION ALL SELECT 2, 'events', CAST(count(*) AS VARCHAR) FROM events")
def kv_report(spark, sf_dir):
    n = table(spark, sf_dir, "events").count()
    return tracelog.report([("components", 1), ("edges", len(list(shop().iter_edges()))), ("events", n)], spark)


# -- a declared workflow of two components ----------------------------------------------------------------------------
@cache
def market() -> Master:
    """Clients (even users) and servers (odd users): a function, a loop, a shared edge, a refresh, three link rules, a call."""
    m = Master("market", Registry().register("market", "client", "server"))
    e1, f1, pay = m.build_func(10, "signup", "pay")
    e2 = f1.build_endf("error")
    e3, n1 = m.build_thread("client", 1, "view", "order")
    e4, _ = n1.build(n1, "click")
    _, n2 = n1.build(2, pay)
    e6, n3 = n2.build(3, "purchase")
    n1.build(n3, e6)
    n3.set_state("BOUGHT")
    e7, n20 = m.build_thread("server", 20, "view")
    e8, _ = n20.build(21, "click")
    e9, n30 = m.build_thread("server", 30, "signup")
    e10, _ = n30.build(31, "error")
    e9.refresh_var("k")
    e4.join_one(e7, True, ["k"])
    e3.join_one(e6, False, [], "pay").call_req(e9, True, [("peer", "target")], e10, True, [("target", "peer")])
    e2.join_any(e8, True, ["k"])
    return m


def market_trace(spark: SparkSession, sf_dir: str) -> Trace:
    t = trace(spark, sf_dir)
    vars_ = F.create_map(F.lit("k"), F.col("k").cast("string"), F.lit("peer"), F.concat(F.lit("p"), (F.col("thread").cast("long") + 1).cast("string")))
    t = t.withColumn("component", F.col("role")).withColumn("vars", vars_).drop("k", "value", "event_id", "role")
    names = t.select("thread").distinct().select(F.concat(F.lit("p"), (F.col("thread").cast("long") + 1).cast("string")).alias("name"), (F.col("thread").cast("long") + 1).cast("string").alias("target"))
    return Trace(t, market(), names)


MARKET = (
    LINES
    + """,
 mw AS (SELECT l.*, CASE WHEN role = 'client' THEN CASE WHEN keyword = 'view' THEN 1 ELSE 0 END ELSE CASE keyword WHEN 'view' THEN 11 WHEN 'signup' THEN 21 ELSE 0 END END AS s, 0 AS s0 FROM lines l WHERE lino = 1
   UNION ALL
   SELECT l.*, CASE WHEN l.role = 'client' THEN CASE WHEN w.s = 1 AND l.keyword = 'click' THEN 1 WHEN w.s = 1 AND l.keyword = 'signup' THEN 2 WHEN w.s = 1 AND l.keyword = 'purchase' THEN 4
       WHEN w.s = 2 AND l.keyword = 'error' THEN 3 WHEN w.s = 3 AND l.keyword = 'purchase' THEN 4 WHEN l.keyword = 'view' THEN 1 ELSE 0 END
     ELSE CASE WHEN w.s = 11 AND l.keyword = 'click' THEN 12 WHEN w.s = 21 AND l.keyword = 'error' THEN 22 WHEN l.keyword = 'view' THEN 11 WHEN l.keyword = 'signup' THEN 21 ELSE 0 END END, w.s
   FROM mw w JOIN lines l ON l.thread = w.thread AND l.lino = w.lino + 1),
 mp0 AS (SELECT *, 'events#' || target || '#' || thread || '#' || lino AS pace_id, keyword = 'view' OR role = 'server' AND keyword = 'signup' AS starts,
   CASE role WHEN 'client' THEN CASE keyword WHEN 'view' THEN 'e3' WHEN 'click' THEN 'e4' WHEN 'signup' THEN 'e1' WHEN 'error' THEN 'e2' ELSE 'e6' END
     ELSE CASE keyword WHEN 'view' THEN 'e7' WHEN 'click' THEN 'e8' WHEN 'signup' THEN 'e9' ELSE 'e10' END END AS edge FROM mw WHERE s > 0),
 mp1 AS (SELECT *, 'events#' || target || '#' || thread || '#' || (sum(starts::INT) OVER (PARTITION BY thread ORDER BY lino) - 1)::BIGINT AS ti_id FROM mp0),
 mv AS (SELECT *, sum((edge = 'e9')::INT) OVER (PARTITION BY target, k ORDER BY lino) AS cnt, max((edge = 'e9')::INT) OVER (PARTITION BY target ORDER BY lino) AS seen FROM mp1),
 mpaces AS (SELECT *, CASE WHEN seen = 1 THEN cnt::BIGINT || ':' || k ELSE k::VARCHAR END AS vk, row_number() OVER (PARTITION BY ti_id ORDER BY lino) - 1 AS seq FROM mv),
 r1 AS (SELECT 'e4>e7' AS rule, 'inner' AS kind, f.pace_id AS from_id, t.pace_id AS to_id, TRUE AS is_remote, NULL AS inp, NULL AS outp FROM
   (SELECT *, row_number() OVER (PARTITION BY vk ORDER BY us, pace_id) AS rn FROM mpaces WHERE edge = 'e4') f JOIN (SELECT *, row_number() OVER (PARTITION BY vk ORDER BY us, pace_id) AS rn FROM mpaces WHERE edge = 'e7') t USING (vk, rn)),
 r3 AS (SELECT 'e2>e8' AS rule, 'inner' AS kind, f.pace_id AS from_id, t.pace_id AS to_id, TRUE AS is_remote, NULL AS inp, NULL AS outp FROM
   (SELECT *, row_number() OVER (PARTITION BY vk ORDER BY us, pace_id) AS rn FROM mpaces WHERE edge = 'e2') f JOIN (SELECT * FROM mpaces WHERE edge = 'e8') t ON f.vk = t.vk AND f.rn = 1),
 rq AS (SELECT f.pace_id AS from_id, t.pace_id AS to_id, f.us AS fu, t.us AS tu, f.pace_id || '>' || t.pace_id AS link_id, (f.target::BIGINT + 1)::VARCHAR AS peer FROM
   (SELECT *, row_number() OVER (PARTITION BY target ORDER BY us, pace_id) AS rn FROM mpaces WHERE edge = 'e3') f JOIN (SELECT *, row_number() OVER (PARTITION BY target ORDER BY us, pace_id) AS rn FROM mpaces WHERE edge = 'e6') t USING (target, rn)),
 cin AS (SELECT q.link_id, t.pace_id AS in_id FROM (SELECT *, row_number() OVER (PARTITION BY peer ORDER BY fu, link_id) AS rn FROM rq) q JOIN (SELECT *, row_number() OVER (PARTITION BY target ORDER BY us, pace_id) AS rn FROM mpaces WHERE edge = 'e9') t ON t.target = q.peer AND t.rn = q.rn),
 cout AS (SELECT q.link_id, t.pace_id AS out_id FROM (SELECT *, row_number() OVER (PARTITION BY peer ORDER BY tu, link_id) AS rn FROM rq) q JOIN (SELECT *, row_number() OVER (PARTITION BY target ORDER BY us, pace_id) AS rn FROM mpaces WHERE edge = 'e10') t ON t.target = q.peer AND t.rn = q.rn),
 nest AS (SELECT q.*, in_id, out_id FROM rq q LEFT JOIN cin USING (link_id) LEFT JOIN cout USING (link_id)),
 ml AS (SELECT rule, kind, from_id, to_id, is_remote FROM r1 UNION ALL SELECT rule, kind, from_id, to_id, is_remote FROM r3
   UNION ALL SELECT 'e3>e6', 'request', from_id, to_id, FALSE FROM nest WHERE in_id IS NULL OR out_id IS NULL
   UNION ALL SELECT 'e3>e6', 'cross_in', from_id, in_id, TRUE FROM nest WHERE in_id IS NOT NULL AND out_id IS NOT NULL
   UNION ALL SELECT 'e3>e6', 'nested', in_id, out_id, FALSE FROM nest WHERE in_id IS NOT NULL AND out_id IS NOT NULL
   UNION ALL SELECT 'e3>e6', 'cross_out', out_id, to_id, TRUE FROM nest WHERE in_id IS NOT NULL AND out_id IS NOT NULL),
 mlinks AS (SELECT ml.*, a.ti_id AS from_ti, b.ti_id AS to_ti, a.host AS from_host, b.host AS to_host, a.role AS from_component, b.role AS to_component, a.target AS from_target, b.target AS to_target,
   CASE WHEN NOT is_remote THEN 'local' WHEN a.host <> b.host THEN 'remote' ELSE 'local_remote' END AS remote_type FROM ml JOIN mpaces a ON a.pace_id = from_id JOIN mpaces b ON b.pace_id = to_id)"""
)


@query(f"WITH RECURSIVE {MARKET} SELECT pace_id, ti_id, edge, vk AS k FROM mpaces")
def workflow_paces(spark, sf_dir):
    """Paces of a declared workflow, a recycled variable versioned."""
    return market_trace(spark, sf_dir).paces.select("pace_id", "ti_id", "edge", F.element_at("vars", F.lit("k")).alias("k"))


@query(f"WITH RECURSIVE {MARKET} SELECT rule, kind, from_id, to_id, remote_type FROM mlinks")
def workflow_links(spark, sf_dir):
    """Its links: first in first out, to any, and requests whose calls are nested."""
    return market_trace(spark, sf_dir).links.select("rule", "kind", "from_id", "to_id", "remote_type")


@query(
    f"""WITH RECURSIVE {MARKET}, w(rule, f, t) AS (VALUES ('e4>e7', 'e4', 'e7'), ('e3>e6', 'e3', 'e6'), ('e2>e8', 'e2', 'e8')),
 whole AS (SELECT rule, from_id, to_id FROM ml WHERE kind = 'inner' UNION ALL SELECT 'e3>e6', from_id, to_id FROM rq)
 SELECT 'from' AS side, pace_id, rule AS rules FROM mpaces JOIN w ON f = edge WHERE pace_id NOT IN (SELECT from_id FROM whole WHERE whole.rule = w.rule)
 UNION ALL SELECT 'to', pace_id, rule FROM mpaces JOIN w ON t = edge WHERE pace_id NOT IN (SELECT to_id FROM whole WHERE whole.rule = w.rule)"""
)
def workflow_misses(spark, sf_dir):
    """Paces that should be linked and are not, with the rules that they miss."""
    return market_trace(spark, sf_dir).misses.select("side", "pace_id", "rules")


@query(f"WITH RECURSIVE {MARKET} SELECT from_ti AS ti_id, 'joins' AS direction, kind, to_ti AS peer_ti, from_id, to_id FROM mlinks WHERE from_ti <> to_ti UNION ALL SELECT to_ti, 'joined', kind, from_ti, from_id, to_id FROM mlinks WHERE from_ti <> to_ti")
def link_adjacency(spark, sf_dir):
    return links.adjacency(market_trace(spark, sf_dir).links)


@query(f"WITH RECURSIVE {MARKET} SELECT to_id, count(*) AS n FROM mlinks GROUP BY to_id HAVING count(*) > 1")
def many_into_one(spark, sf_dir):
    return links.many_into_one(market_trace(spark, sf_dir).links)


@query(f"WITH RECURSIVE {MARKET}, per AS (SELECT from_component, to_component, count(*) AS n FROM mlinks GROUP BY from_target, to_target, from_component, to_component) SELECT from_component, to_component, avg(n) AS mean_links FROM per GROUP BY ALL")
def component_links(spark, sf_dir):
    return report.links_per_target_pair(market_trace(spark, sf_dir).links)


@query(f"WITH RECURSIVE {MARKET}, per AS (SELECT from_component, to_component, count(*) AS n FROM mlinks WHERE remote_type = 'remote' GROUP BY from_target, to_target, from_component, to_component) SELECT from_component, to_component, avg(n) AS mean_links FROM per GROUP BY ALL")
def component_links_remote(spark, sf_dir):
    return report.links_per_target_pair(market_trace(spark, sf_dir).links, remote_only=True)


@query(f"WITH RECURSIVE {MARKET} SELECT kind, remote_type, CASE kind WHEN 'nested' THEN 'nested' WHEN 'request' THEN 'interface' ELSE remote_type END AS colour, count(*) AS n FROM mlinks GROUP BY ALL")
def colour_classes(spark, sf_dir):
    x = market_trace(spark, sf_dir).links
    return x.groupBy("kind", "remote_type", report.colour_class(F.col("kind"), F.col("remote_type"), F.col("from_component")).alias("colour")).agg(F.count("*").alias("n"))


# -- reports ----------------------------------------------------------------------------------------------------------
@query(f"SELECT o_orderpriority AS request_type, 'o_custkey' AS size, {_FIVE.format('o_custkey')} FROM orders GROUP BY 1")
def sizes_by_type(spark, sf_dir):
    return report.sizes_by_type(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "request_type"), ("o_custkey",))


@query(
    f"""WITH {SPANS}, m AS (SELECT *, max(to_us) OVER (PARTITION BY flag ORDER BY from_us, to_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM iv),
 g AS (SELECT flag, count(*) AS n, CAST(sum(greatest(0, to_us - greatest(from_us, coalesce(pm, from_us)))) AS BIGINT) AS busy, CAST(sum(to_us - from_us) AS BIGINT) AS added, max(to_us) - min(from_us) AS span FROM m GROUP BY flag)
 SELECT flag, n, busy, added, span, added / n AS mean, busy / n AS ratio FROM g"""
)
def group_stats(spark, sf_dir):
    return report.group_stats(_orders_as_intervals(spark, sf_dir), ["flag"])


@query("SELECT o_orderpriority, CASE WHEN min(o_custkey) = max(o_custkey) THEN printf('=%.2f', min(o_custkey)::DOUBLE) ELSE printf('%.2f[%.2f|%.2f|%.2f]%.2f', min(o_custkey)::DOUBLE, quantile_cont(o_custkey, 0.25), quantile_cont(o_custkey, 0.5), quantile_cont(o_custkey, 0.75), max(o_custkey)::DOUBLE) END AS dist FROM orders GROUP BY 1")
def dist_text(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(report.dist("o_custkey").alias("dist"))


@query(f"WITH {LINES}, m AS (SELECT thread, lino AS mark FROM lines WHERE keyword = 'error' AND lino % 10 = 0) SELECT m.thread, mark, CAST(lino - mark AS INTEGER) AS \"offset\", keyword FROM m JOIN lines l ON l.thread = m.thread AND lino BETWEEN mark - 3 AND mark + 6")
def line_context(spark, sf_dir):
    t = trace(spark, sf_dir)
    return report.context(t, t.where("keyword = 'error' and lino % 10 = 0")).select("thread", "mark", "offset", "keyword")


@query(f"WITH {LINES},{_zip('view', 'click')} SELECT from_id, to_id, 'view[j]click: view -> click' AS \"desc\", from_host || ' -> ' || to_host AS hosts FROM linked")
def described_links(spark, sf_dir):
    x = _hosted(spark, sf_dir).withColumn("path", stats.path(F.lit("view"), F.lit("j"), F.lit("click"))).withColumn("from_keyword", F.lit("view")).withColumn("to_keyword", F.lit("click"))
    return report.described(x).select("from_id", "to_id", "desc", "hosts")


@query("SELECT event_id, CAST(user_id % 4 AS VARCHAR) AS host, event_type AS kw FROM events")
def file_var_merge(spark, sf_dir):
    """Variables of the file beside those of its lines."""
    e = table(spark, sf_dir, "events")
    host = (F.col("user_id") % 4).cast("string")
    both = tracelog.merge_vars(F.create_map(F.lit("host"), host), tracelog.purge_empty(F.create_map(F.lit("kw"), F.col("event_type"), F.lit("none"), F.lit(""))))
    return e.select("event_id", both.alias("v")).select("event_id", F.element_at("v", "host").alias("host"), F.element_at("v", "kw").alias("kw"))


@query("SELECT CAST(user_id % 10 AS VARCHAR) AS target, count(DISTINCT user_id % 20) AS aliases FROM events GROUP BY 1 HAVING count(DISTINCT user_id % 20) > 1")
def ambiguous_names(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return tracelog.ambiguous_names(e.select((F.col("user_id") % 10).cast("string").alias("target"), (F.col("user_id") % 20).cast("string").alias("alias")))


@query(f"WITH {LINES} SELECT thread, lino, max((k < 50)::INT) OVER (PARTITION BY thread ORDER BY lino) = 1 AS visible FROM lines")
def env_precheck(spark, sf_dir):
    t = trace(spark, sf_dir).withColumn("v", F.when(F.col("k") < 50, F.col("k")))
    return variables.visible_from(t, "thread", "v", ["lino"]).select("thread", "lino", "visible")


@query("SELECT * FROM (VALUES ('gone')) t(component)")
def missing_components(spark, sf_dir):
    t = trace(spark, sf_dir).withColumn("component", F.col("role"))
    return tracelog.missing_components(t, spark.createDataFrame([("client",), ("server",), ("gone",)], "component string"))


@query("SELECT o_orderpriority, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct FROM orders GROUP BY 1")
def dist_by_key(spark, sf_dir):
    return Requests(table(spark, sf_dir, "orders")).distribution("o_orderpriority")


@query(
    f"""WITH RECURSIVE {WALK}, x AS (SELECT min(from_us) AS start, max(to_us) AS "end", max(to_us) AS last FROM insts), r AS (SELECT unnest(['start', 'end', 'last']) AS mark, unnest([start, "end", last]) AS us FROM x)
 SELECT mark, us, printf('%02d:%02d:%02d.%06d', (us // 3600000000) % 24, (us // 60000000) % 60, (us // 1000000) % 60, us % 1000000) AS time FROM r"""
)
def trace_span(spark, sf_dir):
    return clock.span(A.instances(paces(spark, sf_dir)).withColumn("last_us", F.col("to_us")))


@query(f"WITH {LINES} SELECT DISTINCT target, role AS component, host FROM lines")
def frame_targets(spark, sf_dir):
    return frames.targets(market_trace(spark, sf_dir))
