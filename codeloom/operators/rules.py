"""The whole evaluation of a project's rules: eight sections, from one pass over each table of facts.

What a rule asks of a function or of an edge is a row (section, rule, subject, value); rows
are summed by rule and subject, and a sum over the rule's limit is a violation. So every
rule on functions comes from one scan of them, and every rule on edges from one of these.
A rule that is not set is not checked, and makes no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.globs import first_globs, glob_hits, paired
from codeloom.operators.quality import Thresholds, cycles, god_containers, is_brain, undocumented, untested

# Sections in the order in which they are reported, and the limits of each.
SECTIONS = {
    "constraints": ("max_cycles", "max_cc", "max_fn_lines", "no_god_files"),
    "coupling": ("max_fan_in", "max_fan_out"),
    "redundancy": ("max_dead", "max_duplicates"),
    "structural": ("max_nesting_depth", "max_brain_methods", "max_clone_ratio", "no_god_containers"),
    "layering": (),
    "forbidden_imports": (),
    "require_tested": (),
    "require_documented": (),
}


@dataclass(frozen=True)
class Budget:
    """At most so many; or, where ``delta`` is given, that many more than the baseline. Without a baseline a delta rule finds nothing."""

    most: int | None = None
    delta: int | None = None

    def limit(self, baseline: int | None) -> int | None:
        if self.delta is None:
            return self.most
        return None if baseline is None else baseline + self.delta


@dataclass(frozen=True)
class Policy:
    """limits by rule; layers from the lowest, each with its globs; pairs of layers and of globs that must not be; globs of what needs tests or documents."""

    limits: dict[str, int | Budget] = field(default_factory=dict)
    layers: list[tuple[str, list[str]]] = field(default_factory=list)
    boundaries: list[tuple[str, str]] = field(default_factory=list)
    forbidden: list[tuple[str, str]] = field(default_factory=list)
    tested: list[str] = field(default_factory=list)
    documented: list[str] = field(default_factory=list)

    def checked(self) -> int:
        """How many rules are active."""
        return len(self.limits) + bool(self.layers) + len(self.boundaries) + len(self.forbidden) + len(self.tested) + len(self.documented)


@dataclass(frozen=True)
class Facts:
    """functions (id, name, kind, file_path, cc, line_count, nesting, is_dead, is_duplicate, clone_group, is_test, exported);
    imports (source, target) between functions; modules (id, module, directory); containers (id, methods, span); nodes and edges of the store."""

    functions: DataFrame
    imports: DataFrame
    modules: DataFrame
    containers: DataFrame
    nodes: DataFrame
    edges: DataFrame


def _asked(rule: str, subject: Column, value: Column, when: Column | None = None) -> Column:
    row = F.struct(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), value.cast("bigint").alias("value"))
    return F.when(value.isNotNull() if when is None else when & value.isNotNull(), row)


def _rows(table: DataFrame, asked: list[Column]) -> DataFrame:
    return table.select(F.inline(F.array_compact(F.array(*asked)))) if asked else None


def function_rows(functions: DataFrame, limits: dict, t: Thresholds) -> DataFrame | None:
    """(rule, subject, value) of all rules on functions. Single functions appear only where they are over their limit; what is counted has a row each."""
    production, none = ~F.col("is_test"), F.lit("")
    of = lambda rule: F.concat_ws("#", "name", "id")
    asked = []
    for rule, column, where in (("max_cc", "cc", F.lit(True)), ("max_fn_lines", "line_count", F.lit(True)), ("max_nesting_depth", "nesting", production)):
        if rule in limits:
            asked.append(_asked(rule, of(rule), F.col(column), where & (F.col(column) > limits[rule])))
    counted = {
        "no_god_files": (F.col("file_path"), F.lit(1), F.lit(True)),
        "max_dead": (none, F.lit(1), production & F.col("is_dead")),
        "max_duplicates": (none, F.lit(1), production & F.col("is_duplicate")),
        "max_brain_methods": (none, F.lit(1), production & is_brain(t)),
        "max_clone_ratio": (none, F.when(F.col("clone_group").isNotNull(), 10_000).otherwise(0), production),
    }
    asked += [_asked(rule, *how) for rule, how in counted.items() if rule in limits]
    return _rows(functions, asked)


def edge_rows(module_edges: DataFrame, limits: dict) -> DataFrame | None:
    """(rule, subject, value): for both ends of distinct edges (source, target) between modules."""
    other = [("max_fan_in", "target"), ("max_fan_out", "source")]
    return _rows(module_edges, [_asked(rule, F.col(end), F.lit(1)) for rule, end in other if rule in limits])


def evaluate(facts: Facts, policy: Policy, baseline: dict[str, int] | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """(section, rule, subject, value): every violation. ``policy.checked()`` says how many rules that were."""
    budgets = {rule: b if isinstance(b, Budget) else Budget(b) for rule, b in policy.limits.items()}
    limits = {rule: n for rule, b in budgets.items() if (n := b.limit((baseline or {}).get(rule))) is not None}
    production = facts.functions.where("not is_test")
    places = facts.modules.select("id", "module").join(production.select("id", "file_path"), "id")
    ends = facts.imports.join(places.toDF("source", "sm", "sf"), "source").join(places.toDF("target", "tm", "tf"), "target")
    between = ends.select(F.col("sm").alias("source"), F.col("tm").alias("target")).where("source <> target").distinct()
    parts = [function_rows(facts.functions, limits, t), edge_rows(between, limits)]
    if "no_god_containers" in limits:
        parts.append(god_containers(facts.containers, t).select(F.lit("no_god_containers").alias("rule"), F.lit("").alias("subject"), F.lit(1).cast("bigint").alias("value")))
    if "max_cycles" in limits:
        parts.append(cycles(facts.modules, facts.imports).select(F.lit("max_cycles").alias("rule"), F.lit("").alias("subject"), F.col("cycles").alias("value")))
    found = []
    if any(p is not None for p in parts):
        sums = reduce(DataFrame.unionByName, [p for p in parts if p is not None]).groupBy("rule", "subject").agg(
            F.sum("value").alias("sum"), F.avg("value").alias("mean")
        )
        value = F.when(F.col("rule") == "max_clone_ratio", F.round("mean")).otherwise(F.col("sum")).cast("bigint")
        most = F.create_map(*[x for rule, n in limits.items() for x in (F.lit(rule), F.lit(n).cast("bigint"))])
        section = F.create_map(*[F.lit(x) for name, rules in SECTIONS.items() for rule in rules for x in (rule, name)])
        over = sums.select("rule", "subject", value.alias("value")).where(F.col("value") > most[F.col("rule")])
        found.append(over.select(section[F.col("rule")].alias("section"), "rule", "subject", "value"))
    files = ends.select(F.col("sf").alias("source"), F.col("tf").alias("target")).where("source <> target").distinct()
    arrow = F.concat_ws(" -> ", "source", "target").alias("subject")
    one = F.lit(1).cast("bigint").alias("value")
    if policy.layers:
        names = [name for name, _ in policy.layers]
        order = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
        layer = first_globs(places.select(F.col("file_path").alias("path")), policy.layers).where("layer is not null")
        both = files.join(layer.toDF("source", "sl"), "source").join(layer.toDF("target", "tl"), "target")
        kept = F.array(*[F.concat(F.lit(a), F.lit("\n"), F.lit(b)) for a, b in policy.boundaries]) if policy.boundaries else F.array().cast("array<string>")
        ups = F.when(order[F.col("tl")] > order[F.col("sl")], F.lit("layer_order"))
        across = F.when(F.array_contains(kept, F.concat_ws("\n", "sl", "tl")), F.concat(F.lit("boundary "), F.concat_ws("->", "sl", "tl")))
        found.append(both.select(F.lit("layering").alias("section"), F.explode(F.array_compact(F.array(ups, across))).alias("rule"), arrow, one))
    if policy.forbidden:
        found.append(paired(files, policy.forbidden).select(F.lit("forbidden_imports").alias("section"), "rule", arrow, one))
    for section, globs, gaps in (("require_tested", policy.tested, untested(facts.functions, facts.edges)), ("require_documented", policy.documented, undocumented(production.where("exported"), facts.edges, facts.nodes))):
        if globs:
            hit = glob_hits(gaps.select(F.col("file_path").alias("path")), globs)
            named = gaps.join(hit.withColumnRenamed("path", "file_path"), "file_path")
            found.append(named.select(F.lit(section).alias("section"), F.col("glob").alias("rule"), F.concat_ws("#", "name", "id").alias("subject"), one))
    return reduce(DataFrame.unionByName, found)
