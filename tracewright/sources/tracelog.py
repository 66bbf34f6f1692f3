"""Trace logs: scan of text files, line formats, checks, and the report sink."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("log",)) -> list[tuple[str, str]]:
    """(path, name) of the folder's files with these extensions, sorted; not recursive, whatever store the folder is in."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", _glob(extensions)).load(folder)
    return sorted((r["path"], r["path"].rsplit("/", 1)[-1]) for r in found.select("path").collect())


def _glob(extensions: tuple[str, ...]) -> str:
    return "*." + extensions[0] if len(extensions) == 1 else "*.{" + ",".join(extensions) + "}"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, block, line) with the line's number in its block, from 1: a task reads the lines of a block in order."""
    last, n = None, 0
    for b in batches:
        numbers = []
        for at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            last, n = at, n + 1 if at == last else 1
            numbers.append(n)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers, pa.int64())], names=["path", "block", "line", "n"])


def scan(spark: SparkSession, folder: str | list[str], extensions: tuple[str, ...] = ("log",), skip: str | None = None) -> DataFrame:
    """(source, path, lino, line): the lines of the folder's files (or of the files given), numbered from 1 in their file.

    Empty lines count, and are left out. Not recursive. A file is read in blocks, by many tasks if it is large: a line's
    number is that in its block, plus the lines of the blocks before, which are counted first. skip: a regular expression
    for source names that are left out.
    """
    text = spark.read.text(folder) if isinstance(folder, list) else spark.read.option("pathGlobFilter", _glob(extensions)).text(folder)
    path = F.col("_metadata.file_path")
    x = text.select(path.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    source = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    if skip:
        x = x.where(~source.rlike(skip))
    sizes = x.groupBy("path", "block").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("path", "block", F.coalesce(before, F.lit(0)).alias("before"))
    lines = x.mapInArrow(_counted, "path string, block long, line string, n long").where("line <> ''").join(sizes, ["path", "block"])
    return lines.select(source.alias("source"), "path", (F.col("before") + F.col("n")).alias("lino"), "line")


def seconds_of_day(clock: Column) -> Column:
    """H:M:S.f as seconds."""
    p = F.split(clock, ":")
    return p[0].cast("double") * 3600 + p[1].cast("double") * 60 + p[2].cast("double")


def key_values(body: Column, spaced: bool = True, rename: dict[str, str] | None = None) -> Column:
    """`k = v, k = v` (spaced) or `k=v,k=v` as a map; empty values go; keys may be renamed."""
    pairs = F.regexp_extract_all(body, F.lit(r"([\w.]+\s*=\s*[^,}]*)"), F.lit(1))
    part = lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.regexp_replace(p, r"^[^=]*=", "")).alias("v"))
    named = lambda k: F.coalesce(*[F.when(k == a, F.lit(b)) for a, b in (rename or {}).items()], k)
    got = F.filter(F.transform(pairs, part), lambda x: x["v"] != "")
    got = F.transform(got, lambda x: F.struct(named(x["k"]).alias("k"), F.regexp_replace(x["v"], '^"(.*)"$', "$1").alias("v")))
    return F.map_from_entries(got)


def parse(lines: DataFrame, provider: str, components: dict[str, str], spaced: bool = True, rename: dict[str, str] | None = None) -> DataFrame:
    """Lines of `[time] (+delta) host:process:pid provider:keyword: {..}, {..}, {..}` as trace lines.

    Other providers' lines are dropped before anything is parsed. The first brace group is ignored, the next two are
    merged; thread is pthread_id. components maps process names to components; an unknown one raises.
    """
    x = lines.where(F.col("line").contains(f" {provider}:"))
    g = lambda i: F.regexp_extract("line", r"^\[([^\]]+)\].*? (\S+?):([^\s:]+):(\d+) " + provider + r":([^\s:]+):\s*\{([^}]*)\}(?:,\s*\{([^}]*)\})?(?:,\s*\{([^}]*)\})?", i)
    process = g(3)
    known = F.create_map(*[F.lit(v) for kv in components.items() for v in kv])
    vars_ = key_values(F.concat_ws(", ", F.nullif(g(7), F.lit("")), F.nullif(g(8), F.lit(""))), spaced, rename)
    x = x.select("source", "lino", F.col("source").alias("host"), g(1).alias("time"), seconds_of_day(g(1)).alias("seconds"), process.alias("process"), F.concat_ws(":", process, g(4)).alias("target"), g(5).alias("keyword"), vars_.alias("vars"))
    component = F.coalesce(F.get(F.map_values(F.map_filter(known, lambda k, v: k == F.col("process"))), F.lit(0)), F.raise_error(F.concat(F.lit("unknown component "), F.col("process"))).cast("string"))
    return x.select("source", "lino", "host", component.alias("component"), "target", F.element_at("vars", "pthread_id").alias("thread"), "time", "seconds", "keyword", "vars")


def purge_empty(vars_: Column) -> Column:
    return F.map_filter(vars_, lambda k, v: v.isNotNull() & (v != ""))


def merge_vars(file_vars: Column, line_vars: Column) -> Column:
    """Union of both; a key that both set to different values raises."""
    clash = F.filter(F.map_keys(file_vars), lambda k: F.element_at(line_vars, k).isNotNull() & (F.element_at(line_vars, k) != F.element_at(file_vars, k)))
    rest = F.map_filter(file_vars, lambda k, v: ~F.array_contains(F.map_keys(line_vars), k))
    return F.when(F.size(clash) > 0, F.raise_error(F.concat(F.lit("conflict on "), F.array_join(clash, ",")))).otherwise(F.map_concat(line_vars, rest))


REQUIRED = ("thread", "keyword", "time", "seconds")
#: What a file as a whole cannot tell of its lines.
FORBIDDEN = ("request", "seconds", "keyword", "time")


def check_file_vars(vars_: dict[str, str]) -> dict[str, str]:
    """The variables of a file, if they set nothing that only a line can set."""
    if bad := [k for k in FORBIDDEN if k in vars_]:
        raise ValueError(f"a file may not set {', '.join(bad)}")
    return vars_


def check_lines(lines: DataFrame) -> DataFrame:
    """The names of missing mandatory columns of each line (an empty list: the line is good)."""
    have = [c for c in REQUIRED if c in lines.columns]
    missing = [F.when(F.col(c).isNull(), F.lit(c)) for c in have] + [F.lit(c) for c in REQUIRED if c not in lines.columns]
    return lines.withColumn("missing", F.array_compact(F.array(*missing)))


def check_targets(lines: DataFrame) -> DataFrame:
    """Targets whose host or component changes."""
    got = lines.groupBy("target").agg(F.count_distinct("host").alias("hosts"), F.count_distinct("component").alias("components"))
    return got.where("hosts > 1 or components > 1")


def with_alias(lines: DataFrame) -> DataFrame:
    """target_alias after the source's policy: its first line decides whether all lines have one or none has."""
    w = Window.partitionBy("source").orderBy("lino")
    first = F.first(F.col("target_alias").isNotNull()).over(w)
    x = lines.withColumn("_has", first).withColumn("alias_ok", F.col("target_alias").isNotNull() == F.col("_has"))
    return x.withColumn("alias", F.when(F.col("_has"), F.col("target_alias")).otherwise(F.col("target"))).drop("_has")


def ambiguous_names(lines: DataFrame) -> DataFrame:
    """Target names that stand for more than one target."""
    return lines.groupBy("target").agg(F.count_distinct("alias").alias("aliases")).where("aliases > 1")


def component_summary(lines: DataFrame) -> DataFrame:
    """Targets, hosts, threads and lines of each component, with mean and extremes a target."""
    per = lines.groupBy("component", "target", "host").agg(F.count_distinct("thread").alias("threads"), F.count("*").alias("lines"))
    return per.groupBy("component").agg(
        F.count_distinct("target").alias("targets"), F.count_distinct("host").alias("hosts"), F.sum("threads").alias("threads"), F.sum("lines").alias("lines"),
        F.avg("lines").alias("mean_lines"), F.min("lines").alias("min_lines"), F.max("lines").alias("max_lines"),
    )


def missing_components(lines: DataFrame, registered: DataFrame) -> DataFrame:
    return registered.join(lines.select("component").distinct(), "component", "left_anti")


def report(rows: list[tuple[str, object]], spark: SparkSession) -> DataFrame:
    """Ordered key-value report; a repeated key is an error."""
    keys = [k for k, _ in rows if k]
    if len(keys) != len(set(keys)):
        raise ValueError("a report key stands twice")
    return spark.createDataFrame([(i, k, None if v is None else str(v)) for i, (k, v) in enumerate(rows)], "ord int, key string, value string")


def append_csv(df: DataFrame, path: str) -> None:
    """Append rows with a header."""
    df.write.mode("append").option("header", True).csv(path)
