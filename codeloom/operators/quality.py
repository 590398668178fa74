"""Quality metrics over functions, classes and the production graph, and the rules that govern them.

Every metric has a raw and a normalized value. A metric without a subject is null, and a
null drops out of the aggregate; it is never taken for 1 or 0.
"""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.predicates import CALLABLE_KINDS, matches_glob
from codeloom.operators.cycles import components, longest_path, strong_components
from codeloom.operators.relational import with_delta
from codeloom.operators.traverse import reach

FLOOR = 0.01
METRIC_VERSION = 5


@dataclass(frozen=True)
class Thresholds:
    """Fixed default values."""

    nesting: int = 4
    brain_cc: int = 15
    brain_lines: int = 100
    brain_nesting: int = 3
    god_methods: int = 20
    god_span: int = 500

    def digest(self) -> str:
        return hashlib.sha256(";".join(f"{k}={v}" for k, v in sorted(asdict(self).items())).encode()).hexdigest()


def thresholds_digest(**values: Column) -> Column:
    """The digest of thresholds, some of them columns."""
    t = {k: F.lit(str(v)) for k, v in asdict(Thresholds()).items()} | {k: v.cast("string") for k, v in values.items()}
    return F.sha2(F.concat_ws(";", *[F.concat(F.lit(f"{k}="), t[k]) for k in sorted(t)]), 256)


def gini(rows: DataFrame, value: str) -> DataFrame:
    """(gini): of the values that are not null; 0 for one value or a sum of 0.

    Ranks come from counts of distinct values, so rows never meet in one task: a run of n
    equal values x after b smaller ones adds x * n * (b + (n + 1) / 2).
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    x = F.col(value).cast("double")
    sums = counts.withColumn("b", before).agg(F.sum("n").alias("n"), F.sum(x * F.col("n")).alias("s"), F.sum(x * F.col("n") * (F.col("b") + (F.col("n") + 1) / 2)).alias("w"))
    g = 2 * F.col("w") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")
    return sums.select(F.when((F.col("n") <= 1) | F.col("s").isNull() | (F.col("s") == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), g))).alias("gini"))


def modularity(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(q, normalized): of the partition by directory. Loops count twice in degrees; no edges give 0 and a third."""
    s = vertices.select(F.col("id").alias("source"), F.col("directory").alias("a"))
    t = vertices.select(F.col("id").alias("target"), F.col("directory").alias("b"))
    both = edges.join(s, "source").join(t, "target").select("a", "b")
    ends = both.select(F.col("a").alias("d"), F.lit(1).alias("deg"), (F.col("a") == F.col("b")).cast("int").alias("inner")).unionAll(both.select("b", F.lit(1), F.lit(0)))
    by = ends.groupBy("d").agg(F.sum("deg").alias("deg"), F.sum("inner").alias("inner"))
    m = by.agg((F.sum("deg") / 2).alias("m"))
    q = by.join(F.broadcast(m)).agg(F.coalesce(F.sum(F.col("inner") / F.col("m") - F.pow(F.col("deg") / (2 * F.col("m")), 2)), F.lit(0.0)).alias("q"))  # m is one row
    return q.select("q", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("q") + 0.5) / 1.5)).alias("normalized"))


def cycles(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(cycles, normalized): strong components of two or more vertices in two or more directories."""
    by = strong_components(edges).join(vertices.select("id", "directory"), "id").groupBy("scc").agg(F.count("*").alias("n"), F.countDistinct("directory").alias("d"))
    return by.where("n > 1 and d > 1").agg(F.count("*").alias("cycles")).withColumn("normalized", 1 / (1 + F.col("cycles")))


def depth(vertices: DataFrame, edges: DataFrame) -> int:
    """Directories on the longest path between directories, cycles merged."""
    s = vertices.select(F.col("id").alias("source"), F.col("directory").alias("a"))
    t = vertices.select(F.col("id").alias("target"), F.col("directory").alias("b"))
    between = edges.join(s, "source").join(t, "target").where("a <> b").select(F.col("a").alias("source"), F.col("b").alias("target")).distinct()
    return longest_path(vertices.select("directory").distinct(), between)


def _share_without(bad: Column) -> Column:
    return F.when(F.count("*") > 0, F.greatest(1 - F.avg(bad.cast("double")), F.lit(FLOOR)))


def is_brain(t: Thresholds) -> Column:
    return (F.col("cc") >= t.brain_cc) & (F.col("line_count") >= t.brain_lines) & (F.col("nesting") >= t.brain_nesting)


def function_quality(functions: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """(redundancy, nesting, conciseness, uniqueness): normalized, over the given (production) functions."""
    wasted = F.coalesce(F.col("is_dead"), F.lit(False)) | F.coalesce(F.col("is_duplicate"), F.lit(False))
    return functions.agg(
        F.coalesce(1 - F.avg(wasted.cast("double")), F.lit(1.0)).alias("redundancy"),
        _share_without(F.coalesce(F.col("nesting") >= t.nesting, F.lit(False))).alias("nesting"),
        _share_without(F.coalesce(is_brain(t), F.lit(False))).alias("conciseness"),
        _share_without(F.col("clone_group").isNotNull()).alias("uniqueness"),
    )


def lcom4(classes: DataFrame, edges: DataFrame, methods: DataFrame) -> DataFrame:
    """(class, methods, lcom4): groups of a class's methods that share a field or call each other.

    A method is linked with the first of its class that accesses the same target, so a field
    that all methods use gives one link a method.
    """
    own = edges.where("kind = 'contains'").join(classes.select(F.col("id").alias("source")), "source", "left_semi").join(methods.select(F.col("id").alias("target")), "target", "left_semi")
    own = own.select(F.col("source").alias("class"), F.col("target").alias("id"))
    used = edges.where("kind = 'accesses'").select(F.col("source").alias("id"), F.col("target").alias("field")).join(own, "id")
    first = used.groupBy("class", "field").agg(F.min("id").alias("first"))
    shared = used.join(first, ["class", "field"]).where("id <> first").select(F.col("id").alias("source"), F.col("first").alias("target"))
    a, b = own.select(F.col("id").alias("source"), "class"), own.select(F.col("id").alias("target"), F.col("class").alias("other"))
    called = edges.where("kind = 'calls'").join(a, "source").join(b, "target").where("class = other and source <> target").select("source", "target")
    groups = components(own.select("id").distinct(), shared.union(called))
    return own.join(groups, "id").groupBy("class").agg(F.count("*").alias("methods"), F.countDistinct("component").alias("lcom4"))


def cohesion(lcom: DataFrame) -> DataFrame:
    """(cohesion): the mean of 1 / LCOM4; null without a class that has methods."""
    return lcom.agg(F.avg(1 / F.col("lcom4")).alias("cohesion"))


def god_containers(containers: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Containers (id, methods, span) with too many methods or lines."""
    return containers.where((F.col("methods") >= t.god_methods) | (F.col("span") >= t.god_span))


def aggregate_signal(values: DataFrame) -> DataFrame:
    """(signal): the geometric mean of the normalized values that are not null, in ten-thousandths; 0 if one is 0, null without any."""
    v = values.where("normalized is not null")
    return v.agg(
        F.when(F.count("*") == 0, None)
        .when(F.min("normalized") <= 0, 0)
        .otherwise(F.round(F.exp(F.avg(F.ln(F.greatest("normalized", F.lit(1e-12))))) * 10000))
        .cast("bigint")
        .alias("signal")
    )


def offenders(rows: DataFrame, dimension: str, order: list[Column], most: int = 10) -> DataFrame:
    """The worst of a dimension, with their rank; the last order must be a key."""
    top = rows.orderBy(*order).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("dimension", F.lit(dimension))


# Rules


def over(rows: DataFrame, rule: str, subject: str, value: str, most: int) -> DataFrame:
    """(rule, subject, value): a violation for each row whose value exceeds the limit."""
    return rows.where(F.col(value) > most).select(F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"), F.col(value).cast("bigint").alias("value"))


def coupling(module_edges: DataFrame, incoming: bool) -> DataFrame:
    """(module, n): distinct modules that use it, or that it uses."""
    own, other = ("target", "source") if incoming else ("source", "target")
    return module_edges.groupBy(F.col(own).alias("module")).agg(F.countDistinct(other).alias("n"))


def layer_violations(edges: DataFrame, file_layers: DataFrame) -> DataFrame:
    """(source, target): distinct file pairs where the target's layer is above the source's.

    ``edges`` join files; ``file_layers`` has (file, order), null for no layer. Same file and
    files without a layer never violate.
    """
    s, t = file_layers.toDF("source", "so"), file_layers.toDF("target", "to")
    return edges.where("source <> target").join(s, "source").join(t, "target").where("to > so").select("source", "target").distinct()


def boundary_violations(edges: DataFrame, file_layers: DataFrame, forbidden: list[tuple[str, str]]) -> DataFrame:
    """(rule, source, target) for edges between layers that a rule keeps apart; each rule by itself."""
    s, t = file_layers.toDF("source", "sl"), file_layers.toDF("target", "tl")
    both = edges.join(s, "source").join(t, "target")
    rules = F.array(*[F.struct(F.lit(f"{a}->{b}").alias("rule"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in forbidden])
    hit = both.withColumn("r", F.explode(F.filter(rules, lambda r: (r["a"] == F.col("sl")) & (r["b"] == F.col("tl")))))
    return hit.select("r.rule", "source", "target").distinct()


def untested(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Exported callables that no test reaches by calls."""
    tests = functions.where("is_test").select("id")
    reached = reach(edges.where("kind = 'calls'"), tests).select("id")
    return functions.where(F.col("exported") & ~F.col("is_test") & F.col("kind").isin(*CALLABLE_KINDS)).join(reached, "id", "left_anti")


def undocumented(functions: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Functions that no document section refers to."""
    sections = nodes.where("kind = 'doc_section'").select(F.col("id").alias("source"))
    named = edges.where("kind in ('doc_reference', 'traces_to')").join(sections, "source", "left_semi").select(F.col("target").alias("id"))
    return functions.join(named, "id", "left_anti")


def structural_report(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(fault, n): counts that are 0 in a sound store."""
    ids = nodes.select("id")
    parts = [
        nodes.agg(F.lit("duplicate_symbols").alias("fault"), (F.count("*") - F.countDistinct("symbol")).alias("n")),
        edges.join(ids.toDF("source"), "source", "left_anti").agg(F.lit("edges_without_source"), F.count("*")),
        edges.join(ids.toDF("target"), "target", "left_anti").agg(F.lit("edges_without_target"), F.count("*")),
        edges.groupBy("source", "target", "kind").count().where("count > 1").agg(F.lit("repeated_edges"), F.count("*")),
        nodes.where("file_path is not null").join(files.select(F.col("path").alias("file_path")), "file_path", "left_anti").agg(F.lit("nodes_without_file"), F.count("*")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def gated(current: Column, baseline: Column, same_version: Column, same_thresholds: Column, floor: Column, faults: Column) -> Column:
    """struct(passed, reason), decided in this order: no baseline, new version or thresholds, regression, floor, faults."""
    verdict = lambda passed, reason: F.struct(F.lit(passed).alias("passed"), F.lit(reason).alias("reason"))
    return (
        F.when(baseline.isNull(), verdict(True, "no baseline"))
        .when(~same_version, verdict(True, "new metric version: baseline renewed"))
        .when(~same_thresholds, verdict(True, "new thresholds: baseline renewed"))
        .when(current < baseline - 1, verdict(False, "signal below baseline"))
        .when(current < floor, verdict(False, "signal below floor"))
        .when(faults > 0, verdict(False, "structural faults"))
        .otherwise(verdict(True, "ok"))
    )


# Budgets that hold where a project names none.
RECOMMENDED = {
    "max_cycles": 0,
    "max_cc": 15,
    "max_fn_lines": 80,
    "no_god_files": 40,
    "max_fan_in": 30,
    "max_fan_out": 30,
    "max_dead": 0,
    "max_duplicates": 0,
    "max_nesting_depth": 4,
    "max_brain_methods": 0,
    "max_clone_ratio": 0,
    "no_god_containers": 0,
}


def against_budgets(functions: DataFrame, containers: DataFrame, file_edges: DataFrame, vertices: DataFrame, budgets: dict[str, int] = RECOMMENDED, t: Thresholds = Thresholds()) -> DataFrame:
    """(budget, most, value, exceeded) of every budget: the greatest value, or the number of offenders. No subject gives null."""
    one = functions.agg(
        F.max("cc").alias("max_cc"),
        F.max("line_count").alias("max_fn_lines"),
        F.max("nesting").alias("max_nesting_depth"),
        F.count_if("is_dead").alias("max_dead"),
        F.count_if("is_duplicate").alias("max_duplicates"),
        F.count_if(is_brain(t)).alias("max_brain_methods"),
        F.round(F.avg(F.col("clone_group").isNotNull().cast("double")) * 10000).cast("bigint").alias("max_clone_ratio"),
    )
    parts = [one, functions.groupBy("file_path").agg(F.count("*").alias("n")).agg(F.max("n").alias("no_god_files"))]
    parts += [coupling(file_edges, True).agg(F.max("n").alias("max_fan_in")), coupling(file_edges, False).agg(F.max("n").alias("max_fan_out"))]
    parts += [god_containers(containers, t).agg(F.count("*").alias("no_god_containers")), cycles(vertices, file_edges).select(F.col("cycles").alias("max_cycles"))]
    row = parts[0]
    for p in parts[1:]:
        row = row.join(F.broadcast(p))  # one row each
    pairs = F.array(*[F.struct(F.lit(k).alias("budget"), F.lit(v).cast("bigint").alias("most"), F.col(k).cast("bigint").alias("value")) for k, v in budgets.items()])
    return row.select(F.inline(pairs)).withColumn("exceeded", F.col("value") > F.col("most"))


def evolution(snapshots: DataFrame, metrics: list[str], last: int = 30) -> DataFrame:
    """The last snapshots, latest first, with the change of each metric since the one before; null if either is."""
    out = snapshots
    for name in metrics:
        out = with_delta(out, "id", name, f"{name}_delta")
    return out.orderBy(F.desc("id")).limit(last).select("id", *metrics, *[f"{name}_delta" for name in metrics])


def health(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """One row: sizes of a store, its faults, and whether there are none."""
    fault = structural_report(nodes, edges, files)
    n = lambda *names: F.sum(F.when(F.col("fault").isin(*names), F.col("n")).otherwise(0))
    faults = fault.agg(n("nodes_without_file").alias("nodes_without_file"), n("edges_without_source", "edges_without_target").alias("dangling_edges"), (F.sum("n") == 0).alias("healthy"))
    sizes = nodes.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("edges"))).join(files.agg(F.count("*").alias("files")))
    return sizes.join(faults)


def gap_page(gaps: DataFrame, most: int = 50) -> DataFrame:
    """The first gaps by file and name, with whether there are more."""
    first = gaps.orderBy("file_path", "name", "id").limit(most + 1)
    more = first.agg((F.count("*") > most).alias("truncated"))
    return first.orderBy("file_path", "name", "id").limit(most).join(F.broadcast(more))


def regressions(before: DataFrame, after: DataFrame, least: float = 1e-9) -> DataFrame:
    """(metric, drop) of normalized values that fell."""
    both = before.select("metric", F.col("normalized").alias("old")).join(after.select("metric", "normalized"), "metric")
    return both.where(F.col("old") - F.col("normalized") > least).select("metric", (F.col("old") - F.col("normalized")).alias("drop"))
