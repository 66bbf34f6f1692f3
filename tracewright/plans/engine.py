"""Running a declared workflow over trace lines: from lines to paces, links, requests and their intervals.

Everything is declared once, in `spec`; here its edges, links, calls and refreshes become rows and equi-joins. Each part
is a DataFrame, and the few that several others need are written to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators import automaton as A
from tracewright.operators import links as L
from tracewright.operators import requests as R
from tracewright.operators import stats, variables
from tracewright.plans.spec import Edge, Master
from tracewright.session import stage

#: Columns of a line that a schema may name beside its variables.
RESERVED = ("component", "target", "host", "keyword", "request", "time", "seconds")


@dataclass(frozen=True)
class Trace:
    """Lines run through a workflow.

    lines: source, target, thread, lino, host, component, keyword, us (long) and vars (map of strings); request, if there,
    is the id that a line carries. names: (name, target), by which a key on one side is translated where the other side
    is the target; a name that is missing there raises. strict: a variable of a schema that neither the line nor its
    instance has raises, else such items match nothing.
    """

    lines: DataFrame
    master: Master
    names: DataFrame | None = None
    strict: bool = True
    proceed: bool = False

    # -- paces -------------------------------------------------------------------------------------------------------
    @cached_property
    def segmented(self) -> DataFrame:
        return stage(A.segment(self.lines, self.master.compile(), self.proceed), "segmented")

    @cached_property
    def raw_paces(self) -> DataFrame:
        return A.with_ids(self.segmented)

    @cached_property
    def thread_vars(self) -> DataFrame:
        """(ti_id, ti_vars): the variables that have one value throughout an instance, as they were written."""
        v = self.raw_paces.select("ti_id", F.explode("vars").alias("key", "value"))
        one = variables.fold(v, "ti_id", "key", "value").where("single is not null")
        return one.groupBy("ti_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "single"))).alias("ti_vars"))

    @cached_property
    def paces(self) -> DataFrame:
        """Paces with recycled ids versioned, and the variables of their instance."""
        p, edges = self.raw_paces, self.master.refreshes()
        keys = sorted({k for x in edges.values() for k in x})
        if keys:
            refreshed = reduce(lambda a, e: F.when(F.col("edge") == e[0], F.array(*map(F.lit, e[1]))).otherwise(a), edges.items(), F.array().cast("array<string>"))
            v = p.select("pace_id", "target", "source", "lino", F.explode(F.map_filter("vars", lambda k, _: k.isin(keys))).alias("key", "value"), refreshed.alias("fresh"))
            v = variables.refresh(v, "target", ["source", "lino"], "key", "value", F.array_contains("fresh", F.col("key")))
            new = v.groupBy("pace_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "versioned"))).alias("new"))
            both = F.map_concat(F.map_filter("vars", lambda k, _: ~k.isin(keys)), F.coalesce("new", F.create_map().cast("map<string,string>")))
            p = p.join(new, "pace_id", "left").withColumn("vars", both).drop("new")
        return stage(p.join(self.thread_vars, "ti_id", "left"), "paces")

    def field(self, name: str) -> Column:
        """A pace's value of a schema's name, as a string: the line's own column or variable, else the instance's variable."""
        if name in RESERVED and name in self.lines.columns:
            return F.col(name).cast("string")
        got = F.coalesce(F.element_at("vars", F.lit(name)), F.element_at("ti_vars", F.lit(name)))
        return F.coalesce(got, F.raise_error(F.concat(F.lit(f"variable {name} is missing at "), F.col("pace_id"))).cast("string")) if self.strict else got

    def items(self, edge: Edge, schema: list[tuple[str, str]], side: int) -> DataFrame:
        """(pace_id, us, k0, k1, ...) of an edge's paces, keyed by their side of a schema."""
        p = self.paces.where(F.col("edge") == edge.name)
        p = p.select("pace_id", "us", *[self.field(pair[side]).alias(f"k{i}") for i, pair in enumerate(schema)])
        for i, pair in enumerate(schema):
            if pair[side] != "target" and pair[1 - side] == "target" and self.names is not None:
                known = self.names.select(F.col("name").alias(f"k{i}"), F.col("target").alias("_to"))
                missing = F.raise_error(F.concat(F.lit("no target is named "), F.col(f"k{i}"))).cast("string")
                p = p.join(known, f"k{i}", "left").withColumn(f"k{i}", F.when(F.col(f"k{i}").isNull(), None).otherwise(F.coalesce("_to", missing))).drop("_to")
        return p.select("pace_id", "us", *[f"k{i}" for i in range(len(schema))])

    # -- links -------------------------------------------------------------------------------------------------------
    @cached_property
    def matched(self) -> DataFrame:
        """All declared links: rule, kind (inner or request), request_name, is_remote, from_id, to_id, from_us, to_us."""
        spark = self.lines.sparkSession
        out = []
        taken: list[tuple] = []
        for link in self.master.links():
            f, t = self.items(link.source, link.schema, 0), self.items(link.target, link.schema, 1)
            for earlier, got in taken:  # in declaration order: what an earlier rule took takes no further part
                if earlier.target is link.target:
                    t = t.join(got.select(F.col("to_id").alias("pace_id")), "pace_id", "left_anti")
                if link.strategy == "ONE" and earlier.source is link.source:
                    f = f.join(got.select(F.col("from_id").alias("pace_id")).distinct(), "pace_id", "left_anti")
            got = L.link(f, t, [f"k{i}" for i in range(len(link.schema))], link.strategy).select("from_id", "to_id", "from_us", "to_us")
            got = stage(got, "links")
            taken.append((link, got))
            kind = F.lit("request" if link.request else "inner")
            out.append(got.select(F.lit(link.name).alias("rule"), kind.alias("kind"), F.lit(link.request).cast("string").alias("request_name"), F.lit(link.remote).alias("is_remote"), "from_id", "to_id", "from_us", "to_us"))
        if not out:
            return spark.createDataFrame([], "rule string, kind string, request_name string, is_remote boolean, from_id string, to_id string, from_us long, to_us long")
        return self._placed(reduce(DataFrame.unionAll, out).where("kind = 'request' or from_id <> to_id"))

    def _placed(self, links: DataFrame) -> DataFrame:
        """Links with the instances and hosts of their ends, and what their remoteness comes to."""
        at = self.paces.select("pace_id", "ti_id", "host", "target", "component")
        for side in ("from", "to"):
            links = links.join(at.select(F.col("pace_id").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{'ti' if c == 'ti_id' else c}") for c in at.columns[1:]]), f"{side}_id")
        return links.withColumn("remote_type", L.remote_type(F.col("is_remote"), F.col("from_host"), F.col("to_host")))

    @cached_property
    def calls(self) -> DataFrame:
        """Request links whose callee was entered and left: request link, and the callee's two paces."""
        out = []
        for link in self.master.links():
            if link.call is None:
                continue
            enter, leave = link.call
            rows = self.matched.where(F.col("rule") == link.name).select(F.concat_ws(">", "from_id", "to_id").alias("pace_id"), "from_id", "to_id")
            keyed = {}
            for side, call, edge, own in (("from", enter, link.source, 0), ("to", leave, link.target, 1)):
                x = self.items(edge, call.schema, own).withColumnRenamed("pace_id", f"{side}_id")
                keyed[side] = rows.join(x, f"{side}_id").drop("from_id", "to_id")
            inn = L.link(keyed["from"], self.items(enter.edge, enter.schema, 1), [f"k{i}" for i in range(len(enter.schema))], "ALL")
            out_ = L.link(self.items(leave.edge, leave.schema, 0), keyed["to"], [f"k{i}" for i in range(len(leave.schema))], "ALL")
            both = rows.withColumnRenamed("pace_id", "link_id").join(inn.select(F.col("from_id").alias("link_id"), F.col("to_id").alias("in_id"), F.col("to_us").alias("in_us"), F.lit(enter.remote).alias("in_remote")), "link_id", "left")
            out.append(both.join(out_.select(F.col("to_id").alias("link_id"), F.col("from_id").alias("out_id"), F.col("from_us").alias("out_us"), F.lit(leave.remote).alias("out_remote")), "link_id", "left"))
        if not out:
            return self.lines.sparkSession.createDataFrame([], "link_id string, from_id string, to_id string, in_id string, in_us long, in_remote boolean, out_id string, out_us long, out_remote boolean")
        return stage(reduce(DataFrame.unionAll, out), "calls")

    @cached_property
    def links(self) -> DataFrame:
        """Links as the paths take them: a request link whose callee was entered and left is three, into it (`cross_in`),
        inside it (`nested`, local, in the callee's target) and back (`cross_out`); others stay as they are.

        from_path and to_path are the paces of the way: those of a callee are copies that belong to the call, so that a
        call does not lead the callee's own request astray. owner_ti is the caller's instance.
        """
        whole = self.calls.where("in_id is not null and out_id is not null")
        target = self.paces.select("pace_id", "target")
        ends = whole.join(target.select(F.col("pace_id").alias("in_id"), F.col("target").alias("_a")), "in_id").join(target.select(F.col("pace_id").alias("out_id"), F.col("target").alias("_b")), "out_id")
        whole = ends.withColumn("in_id", F.when(F.col("_a") == F.col("_b"), F.col("in_id")).otherwise(F.raise_error(F.lit("a callee is entered and left in two targets")).cast("string"))).drop("_a", "_b")
        m = self.matched.join(whole.select("from_id", "to_id", "in_id", "in_us", "in_remote", "out_id", "out_us", "out_remote"), ["from_id", "to_id"], "left")
        here, copy = lambda c: F.col(c), lambda c: F.concat(F.col(c), F.lit("@"), "from_id", F.lit(">"), "to_id")

        def part(kind: Column, remote: Column, a: str, au: str, pa: Column, b: str, bu: str, pb: Column) -> Column:
            named = {"kind": kind, "is_remote": remote, "from_id": F.col(a), "to_id": F.col(b), "from_us": F.col(au), "to_us": F.col(bu), "from_path": pa, "to_path": pb}
            return F.struct(*[c.alias(n) for n, c in named.items()])

        one = F.array(part(F.col("kind"), F.col("is_remote"), "from_id", "from_us", here("from_id"), "to_id", "to_us", here("to_id")))
        three = F.array(
            part(F.lit("cross_in"), F.col("in_remote"), "from_id", "from_us", here("from_id"), "in_id", "in_us", copy("in_id")),
            part(F.lit("nested"), F.lit(False), "in_id", "in_us", copy("in_id"), "out_id", "out_us", copy("out_id")),
            part(F.lit("cross_out"), F.col("out_remote"), "out_id", "out_us", copy("out_id"), "to_id", "to_us", here("to_id")),
        )
        rows = m.select("rule", "request_name", F.col("from_ti").alias("owner_ti"), F.explode(F.when(F.col("in_id").isNotNull(), three).otherwise(one)).alias("x"))
        return stage(self._placed(rows.select("rule", "request_name", "owner_ti", "x.*")), "linked")

    @cached_property
    def misses(self) -> DataFrame:
        """(side, pace_id, ti_id, rules) of the paces that should be linked and are not; for ALL a row for each rule missed."""
        ti = self.paces.select("pace_id", "ti_id", "edge")
        out = []
        for side, of in (("from", lambda x: x.source), ("to", lambda x: x.target)):
            by_edge: dict[str, list] = {}
            for link in self.master.links():
                by_edge.setdefault(of(link).name, []).append(link)
            for edge, rules in by_edge.items():
                names = [x.name for x in rules]
                strategy = rules[0].strategy if side == "from" else "ONE"
                own = self.matched.where(F.col("rule").isin(names))
                got = L.named_misses(ti.where(F.col("edge") == edge), own, side, names, strategy)
                out.append(got.join(ti.select("pace_id", "ti_id"), "pace_id").select(F.lit(side).alias("side"), "pace_id", "ti_id", "rules"))
        if not out:
            return self.lines.sparkSession.createDataFrame([], "side string, pace_id string, ti_id string, rules string")
        return reduce(DataFrame.unionAll, out)

    # -- requests ----------------------------------------------------------------------------------------------------
    @cached_property
    def instances(self) -> DataFrame:
        extra = [F.min("host").alias("host"), F.min("component").alias("component")]
        if "request" in self.lines.columns:
            one = F.count_distinct("request")
            extra.append(F.when(one > 1, F.raise_error(F.lit("an instance carries two request ids")).cast("string")).otherwise(F.min("request")).alias("request"))
        p = self.raw_paces
        more = p.groupBy("ti_id").agg(*extra)
        return stage(A.instances(p).join(more, "ti_id"), "instances")

    @cached_property
    def _ways(self) -> DataFrame:
        """Instance to instance, as grouping takes links: nested parts do not count, the request link that they replace does."""
        return self.matched.select("from_ti", "to_ti").where("from_ti <> to_ti")

    @cached_property
    def members(self) -> DataFrame:
        group_of = R.groups(self.instances, self._ways)
        return stage(R.members(self.instances, group_of, self._ways), "members")

    @cached_property
    def _main(self) -> tuple[DataFrame, DataFrame]:
        m = self.members.where("is_member").select("ti_id", "group_id")
        p = self.paces.join(m, "ti_id").select("group_id", "pace_id", "ti_id", "seq", (F.col("request_type").isNotNull() & (F.col("seq") == 0)).alias("is_start"), F.col("request_state").isNotNull().alias("is_end"))
        called = self.links.where("kind = 'nested'").join(m.withColumnRenamed("ti_id", "owner_ti"), "owner_ti")
        copies = called.select("group_id", F.explode(F.array("from_path", "to_path")).alias("pace_id"))
        no = F.lit(False)
        p = p.unionByName(copies.select("group_id", "pace_id", F.col("pace_id").alias("ti_id"), F.lit(0).alias("seq"), no.alias("is_start"), no.alias("is_end")))
        return R.main_paths(p, self.links.select(F.col("from_path").alias("from_id"), F.col("to_path").alias("to_id")))

    @cached_property
    def main_path(self) -> DataFrame:
        """(group_id, pos, kind, from_id, to_id)."""
        return stage(self._main[0], "main")

    @cached_property
    def groups(self) -> DataFrame:
        """One row a group, valid or not."""
        return stage(R.build(self.members, self._main[1]), "groups")

    @cached_property
    def requests(self) -> DataFrame:
        """The valid requests, named."""
        return R.auto_names(self.groups.where("size(errors) = 0"))

    @cached_property
    def request_vars(self) -> DataFrame:
        """(group_id, key, values): the variables of a valid request's members, as sets; and its hosts, targets, threads, components."""
        m = self.members.where("is_member").join(self.groups.where("size(errors) = 0").select("group_id"), "group_id", "left_semi")
        own = F.create_map(F.lit("host"), F.col("host").cast("string"), F.lit("target"), F.col("target"), F.lit("thread"), F.concat_ws(":", "target", "thread"), F.lit("component"), F.col("component"))
        v = m.select("group_id", F.explode(own).alias("key", "value"))
        v = v.unionAll(self.raw_paces.join(m.select("ti_id", "group_id"), "ti_id").select("group_id", F.explode("vars").alias("key", "value")))
        return v.where("value is not null").groupBy("group_id", "key").agg(F.sort_array(F.collect_set("value")).alias("values"))

    # -- intervals ---------------------------------------------------------------------------------------------------
    @cached_property
    def thread_intervals(self) -> DataFrame:
        """Intervals inside instances of valid requests, with their request, kind, path and whether they are on its main path."""
        x = self.paces.join(self._valid("ti_id"), "ti_id")
        w = Window.partitionBy("ti_id").orderBy("seq")
        nxt = lambda c: F.lead(c).over(w)
        x = x.select("group_id", "ti_id", F.col("pace_id").alias("from_id"), nxt("pace_id").alias("to_id"), F.col("us").alias("from_us"), nxt("us").alias("to_us"), F.col("edge").alias("from_edge"), F.col("to_node").alias("int_name"), nxt("edge").alias("to_edge"), "host", "target", "component", "thread").where("to_id is not null")
        return self._described(x.withColumn("int_type", F.lit("thread")), "thread", "from_id", "to_id")

    @cached_property
    def join_intervals(self) -> DataFrame:
        """Link intervals of valid requests."""
        x = self.links.join(self._valid("owner_ti"), "owner_ti").drop("is_remote")
        edge = self.paces.select("pace_id", "edge")
        x = x.join(edge.select(F.col("pace_id").alias("from_id"), F.col("edge").alias("from_edge")), "from_id").join(edge.select(F.col("pace_id").alias("to_id"), F.col("edge").alias("to_edge")), "to_id")
        name = F.coalesce(F.concat(F.lit("q_"), "request_name"), F.concat(F.lit("j_"), "rule"))
        return self._described(x.withColumn("int_name", name).withColumnRenamed("kind", "int_type"), "link", "from_path", "to_path").drop("from_path", "to_path")

    def _valid(self, ti: str) -> DataFrame:
        good = self.groups.where("size(errors) = 0").select("group_id")
        return self.members.where("is_member").join(good, "group_id", "left_semi").select(F.col("ti_id").alias(ti), "group_id")

    def _described(self, x: DataFrame, kind: str, a: str, b: str) -> DataFrame:
        main = self.main_path.where(F.col("kind") == kind).select("group_id", F.col("from_id").alias(a), F.col("to_id").alias(b), F.col("pos").alias("main_pos"))
        x = x.join(main, ["group_id", a, b], "left").withColumn("is_main", F.col("main_pos").isNotNull())
        x = x.withColumn("lapse", F.col("to_us") - F.col("from_us"))
        return x.withColumn("path", stats.path(F.col("from_edge"), F.col("int_name"), F.col("to_edge")))
