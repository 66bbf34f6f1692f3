"""First-in-first-out links between paces by key, as ranked equi-joins.

The n-th to-item of a key (by time) takes the n-th from-item, which is what a greedy scan does, without ever making the
pairs of a key. Ranking is one window per side; the join is an ordinary equi-join on (key, rank).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import stage


def _ranked(items: DataFrame, key: list[str], time: str, ident: str) -> DataFrame:
    return items.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(time, ident)))


def link(froms: DataFrame, tos: DataFrame, key: list[str], strategy: str = "ONE", time: str = "us", ident: str = "pace_id") -> DataFrame:
    """(from_id, to_id, from_us, to_us, key...) of one rule.

    ONE and ALL: n-th to n-th. ANY: each to-item links to the key's earliest from-item. A to-item has one link at most.
    Negative lapses are legal. Null keys match nothing.
    """
    f, t = (x.dropna(subset=key) for x in (froms, tos))
    f = _ranked(f, key, time, ident).select(*key, "rn", F.col(ident).alias("from_id"), F.col(time).alias("from_us"))
    if strategy == "ANY":
        f = f.where("rn = 1").drop("rn")
        t = t.select(*key, F.col(ident).alias("to_id"), F.col(time).alias("to_us"))
        return t.join(f, key)
    t = _ranked(t, key, time, ident).select(*key, "rn", F.col(ident).alias("to_id"), F.col(time).alias("to_us"))
    return t.join(f, [*key, "rn"]).drop("rn")


def link_rules(rules: list[dict], froms: dict[str, DataFrame], tos: dict[str, DataFrame], ident: str = "pace_id") -> DataFrame:
    """Rules in declaration order: ONE from-items and all to-items that an earlier rule matched take no further part.

    Rules: name, from, to (keys of froms and tos), key, strategy. Only what rules with the same side could have taken is
    looked up.
    """
    out: list[tuple[dict, DataFrame]] = []
    for rule in rules:
        f, t = froms[rule["from"]], tos[rule["to"]]
        for earlier, got in out:
            if earlier["to"] == rule["to"] or tos[earlier["to"]] is t:
                t = t.join(got.select(F.col("to_id").alias(ident)), ident, "left_anti")
            if rule["strategy"] == "ONE" and (earlier["from"] == rule["from"] or froms[earlier["from"]] is f):
                f = f.join(got.select(F.col("from_id").alias(ident)).distinct(), ident, "left_anti")
        got = link(f, t, rule["key"], rule["strategy"], ident=ident).select("from_id", "to_id", "from_us", "to_us")
        out.append((rule, stage(got.withColumn("rule", F.lit(rule["name"])), "links")))
    return reduce(DataFrame.unionAll, (got for _, got in out))


def misses(items: DataFrame, links: DataFrame, side: str, ident: str = "pace_id") -> DataFrame:
    """Items of a side that have no link."""
    return items.join(links.select(F.col(f"{side}_id").alias(ident)), ident, "left_anti")


def named_misses(items: DataFrame, links: DataFrame, side: str, rules: list[str], strategy: str = "ONE", ident: str = "pace_id") -> DataFrame:
    """(pace_id, rules) of the items that fail: for ONE and ANY one row that names all their rules, for ALL a row for each rule missed."""
    if strategy != "ALL":
        return misses(items, links, side, ident).select(ident, F.lit("/".join(rules)).alias("rules"))
    wanted = items.select(ident, F.explode(F.array(*map(F.lit, rules))).alias("rules"))
    return wanted.join(links.select(F.col(f"{side}_id").alias(ident), F.col("rule").alias("rules")), [ident, "rules"], "left_anti")


def remote_type(is_remote: Column, from_host: Column, to_host: Column) -> Column:
    return F.when(~is_remote, "local").when(from_host != to_host, "remote").otherwise("local_remote")


def diagnostics(froms: DataFrame, tos: DataFrame, links: DataFrame) -> DataFrame:
    """Counts of one rule: links, unmatched sides, negative lapses with their largest and mean size."""
    lapse = F.col("to_us") - F.col("from_us")
    a = links.agg(
        F.count("*").alias("n_links"),
        F.count(F.when(lapse < 0, 1)).alias("n_negative"),
        F.max(F.when(lapse < 0, -lapse)).alias("max_negative_us"),
    )
    n_from, n_to = (x.agg(F.count("*")).scalar() for x in (froms, tos))
    joined = a.withColumn("n_from", n_from).withColumn("n_to", n_to)
    return joined.withColumn("from_missed", F.col("n_from") - F.col("n_links")).withColumn("to_missed", F.col("n_to") - F.col("n_links"))


def match_diagnostics(froms: DataFrame, tos: DataFrame, links: DataFrame, key: list[str], ident: str = "pace_id") -> DataFrame:
    """One row a side: items whose key the other side lacks (nomatch), those that met others but got no link
    (novalidmatch), those that met several (multi), with the most and the mean they met.

    Items meet by counts a key, never as pairs.
    """
    sides = {"from": (froms, tos), "to": (tos, froms)}
    out = []
    for side, (own, other) in sides.items():
        met = other.dropna(subset=key).groupBy(*key).agg(F.count("*").alias("met"))
        linked = links.select(F.col(f"{side}_id").alias(ident), F.lit(True).alias("linked")).distinct()
        x = own.join(met, key, "left").join(linked, ident, "left").select(F.coalesce("met", F.lit(0)).alias("met"), F.coalesce("linked", F.lit(False)).alias("linked"))
        several = F.when(F.col("met") > 1, F.col("met"))
        out.append(
            x.agg(
                F.count(F.when(F.col("met") == 0, 1)).alias("nomatch"),
                F.count(F.when((F.col("met") > 0) & ~F.col("linked"), 1)).alias("novalidmatch"),
                F.count(several).alias("multi"),
                F.max(several).alias("most"),
                F.avg(several).alias("mean"),
            ).select(F.lit(side).alias("side"), "*")
        )
    return out[0].unionAll(out[1])


def ambiguous(froms: DataFrame, tos: DataFrame, links: DataFrame, key: list[str], k: int = 20, time: str = "us", ident: str = "pace_id") -> DataFrame:
    """The first k items, by time, whose key stands on a side more than once, and whether they got a link."""
    both = [x.dropna(subset=key).select(*key, F.lit(side).alias("side"), ident, time) for side, x in (("from", froms), ("to", tos))]
    items = both[0].unionAll(both[1])
    per = items.groupBy(*key).agg(F.count(F.when(F.col("side") == "from", 1)).alias("f"), F.count(F.when(F.col("side") == "to", 1)).alias("t"))
    several = per.where("f > 0 and t > 0 and f + t > 2").select(*key)
    linked = links.select(F.lit("from").alias("side"), F.col("from_id").alias(ident)).unionAll(links.select(F.lit("to"), "to_id")).distinct()
    x = items.join(several, key, "left_semi").join(linked.withColumn("linked", F.lit(True)), ["side", ident], "left")
    return x.withColumn("linked", F.coalesce("linked", F.lit(False))).orderBy(time, "side", ident).limit(k)


def many_into_one(links: DataFrame) -> DataFrame:
    """Paces that more than one link enters: (to_id, n). A sound trace has none; a link may leave a pace any number of times."""
    return links.groupBy("to_id").agg(F.count("*").alias("n")).where("n > 1")


def adjacency(links: DataFrame, misses_: DataFrame | None = None) -> DataFrame:
    """Links and misses by instance: (ti_id, direction, kind, peer_ti, from_id, to_id).

    links: kind, from_ti, to_ti, from_id, to_id; misses_: side, ti_id, pace_id. A link stands at both its instances (`joins`
    where it leaves, `joined` where it enters), one inside an instance nowhere; a miss is of the kind `empty`.
    """
    x = links.where("from_ti <> to_ti")
    side = lambda name, own, peer: x.select(F.col(own).alias("ti_id"), F.lit(name).alias("direction"), "kind", F.col(peer).alias("peer_ti"), "from_id", "to_id")
    both = side("joins", "from_ti", "to_ti").unionAll(side("joined", "to_ti", "from_ti"))
    if misses_ is None:
        return both
    leaves = F.col("side") == "from"
    none = F.lit(None).cast("string")
    empty = misses_.select("ti_id", F.when(leaves, "joins").otherwise("joined").alias("direction"), F.lit("empty").alias("kind"), none.alias("peer_ti"), F.when(leaves, F.col("pace_id")).alias("from_id"), F.when(~leaves, F.col("pace_id")).alias("to_id"))
    return both.unionAll(empty)


def success(links: DataFrame, strategy: str, rules: list[str]) -> DataFrame:
    """Per from-item: ONE and ANY succeed with one link at least, ALL with exactly one in every rule."""
    per = links.groupBy("from_id", "rule").agg(F.count("*").alias("n")).groupBy("from_id").agg(F.count("*").alias("rules"), F.max("n").alias("most"), F.sum("n").alias("links"))
    ok = (F.col("rules") == len(rules)) & (F.col("most") == 1) if strategy == "ALL" else F.col("links") >= 1
    return per.select("from_id", "links", ok.alias("success"))


def nest(requests: DataFrame, entering: DataFrame, leaving: DataFrame) -> DataFrame:
    """A request link whose call was entered and left becomes three intervals: into the callee, inside it, and back.

    requests: from_id, to_id, from_us, to_us; entering: from_id -> to_id in the callee; leaving: from_id in the callee -> to_id.
    """
    inn = entering.select("from_id", F.col("to_id").alias("in_id"), F.col("to_us").alias("in_us"))
    out = leaving.select("to_id", F.col("from_id").alias("out_id"), F.col("from_us").alias("out_us"))
    both = requests.join(inn, "from_id").join(out, "to_id")
    part = lambda kind, a, au, b, bu: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(au).alias("a_us"), F.col(b).alias("b"), F.col(bu).alias("b_us"))
    parts = F.array(part("enter", "from_id", "from_us", "in_id", "in_us"), part("nested", "in_id", "in_us", "out_id", "out_us"), part("leave", "out_id", "out_us", "to_id", "to_us"))
    return both.select(F.col("from_id").alias("request_from"), F.explode(parts).alias("p")).select("request_from", "p.*")
