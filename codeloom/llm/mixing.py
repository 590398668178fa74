"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

Leaves of a tree of columns (domain, language, source) hold documents. A token budget is
handed down the tree by weight. A child gets at most what its subtree can give, which is
its tokens times the largest number of epochs; what it can't use goes to its siblings by
their weights, and only what no sibling can use stays with their parent, whose own
siblings then have it (since a parent never gets more than its subtree can give, handing
down from the root does both). Each leaf takes whole epochs and then a prefix, in tokens,
of the next epoch; the order within an epoch is that of a seeded hash.

Where a prefix ends is found without sorting a leaf: sums over the ranges of the hash
narrow the place down, each time 4,096-fold, so that a leaf of 10^10 documents leaves
some 600 to be put in order.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import WORD, materialize, quoted

WIDE = "decimal(38,0)"


@dataclass(frozen=True)
class MixConfig:
    """weights: for each level the weight of a value, as whole numbers; 1 where none is given, and 0 leaves the value out.

    The budget is ``percent`` of all tokens there are, so it follows the input.
    """

    levels: tuple[str, ...] = ("domain", "lang", "source")
    weights: dict[str, dict[str, int]] = field(
        default_factory=lambda: {
            "domain": {"domain0": 5, "domain1": 3, "domain2": 2},
            "lang": {"en": 4, "de": 2, "fr": 2, "es": 1},
        }
    )
    percent: int = 60
    max_epochs: int = 2
    seed: int = 7
    digits: int = 3  # hexadecimal digits: a range of an epoch's order is cut into 16^3 at a time
    narrowings: int = 2


def domain_of(source: Column) -> Column:
    """The domain of a source: here by the number in its name."""
    return F.concat(F.lit("domain"), F.pmod(F.coalesce(F.regexp_extract(source, r"(\d+)", 1).try_cast("bigint"), F.lit(0)), F.lit(3)))


def _weight(level: str, c: MixConfig) -> Column:
    w = F.lit(1)
    for value, n in c.weights.get(level, {}).items():
        w = F.when(F.col(level) == value, n).otherwise(w)
    return w.cast("bigint")


def _handed_down(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """``budget`` of each node from ``parent_budget``, by weight, and ``capacity`` at most.

    In the order of capacity for each unit of weight, a node is full if its capacity is at
    most its share of what the nodes before it leave; the nodes after the last full one
    share what is left. Shares are rounded down.
    """
    ordered = Window.partitionBy(*parent).orderBy(F.expr("coalesce(cast(capacity as decimal(22,0)) * 1000 div nullif(weight, 0), 0)"), *[c for c in nodes.columns if c.startswith("_l")])
    before, after = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(0, Window.unboundedFollowing)
    n = nodes.withColumns(
        {
            "_left": (F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))).cast(WIDE),
            "_weight": F.sum("weight").over(after).cast(WIDE),
            "_at": F.row_number().over(ordered),
        }
    )
    full = F.col("capacity").cast(WIDE) * F.col("_weight") <= F.col("weight").cast(WIDE) * F.col("_left")
    n = n.withColumn("_first", F.min(F.when(~full, F.struct("_at", "_left", "_weight"))).over(Window.partitionBy(*parent)))
    # A weight of 0 comes with a capacity of 0: full at nothing, and nothing is left to those alone.
    share = F.expr("cast(weight as decimal(19,0)) * cast(_first._left as decimal(19,0)) div nullif(_first._weight, 0)")
    is_full = F.col("_first").isNull() | (F.col("_at") < F.col("_first._at"))
    return n.withColumn("budget", F.when(is_full, F.col("capacity")).otherwise(F.greatest(share, F.lit(0))).cast("bigint"))


def counted(docs: DataFrame, key: str, text: str, c: MixConfig, box: Column | None = None) -> DataFrame:
    """(box, k, _l0, _l1, ..., n_tokens): the key, the levels, and the words of the whole text.

    ``box`` is whatever of the row the caller wants to have back; by default nothing.
    """
    levels = [F.coalesce(quoted(x).cast("string"), F.lit("(none)")).alias(f"_l{i}") for i, x in enumerate(c.levels)]
    n = F.coalesce(F.regexp_count(quoted(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select((F.lit(None).cast("boolean") if box is None else box).alias("box"), quoted(key).alias("k"), *levels, n.alias("n_tokens"))


def _rank(epoch: Column, c: MixConfig) -> Column:
    """A document's place in the order of an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(c.seed)), epoch.cast("string"), F.col("k").cast("string")).cast("binary"))


def leaf_plan(tokens: DataFrame, c: MixConfig = MixConfig()) -> DataFrame:
    """A row a leaf: available, budget, full_epochs, rest, and where the prefix of the last epoch ends.

    ``tokens`` is what counted() gives, from a written table since it is read several times.
    cut is (rank, key) of the last document of the prefix, and cut_take the tokens it gives.
    """
    names = [f"_l{i}" for i in range(len(c.levels))]
    leaves = tokens.groupBy(*names).agg(F.sum("n_tokens").alias("available")).where("available > 0")
    none = reduce(operator.or_, [_weight(n, MixConfig(weights={n: c.weights.get(x, {})})) == 0 for n, x in zip(names, c.levels)], F.lit(False))
    tree = leaves.withColumn("capacity", F.when(none, 0).otherwise(F.col("available") * c.max_epochs))
    total = tree.agg(F.expr(f"cast(sum(available) * {c.percent} div 100 as bigint)").alias("parent_budget"))
    for depth in range(1, len(names) + 1):
        path = names[:depth]
        nodes = tree.groupBy(*path).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("weight", _weight(path[-1], MixConfig(weights={path[-1]: c.weights.get(c.levels[depth - 1], {})})))
        if depth == 1:
            nodes, parent = nodes.join(F.broadcast(total), how="cross"), [F.lit(0)]  # one row
        else:
            nodes, parent = nodes.join(above, path[:-1]), path[:-1]
        above = _handed_down(nodes, parent).select(*path, F.col("budget").alias("parent_budget"))
    plan = leaves.join(above.withColumnRenamed("parent_budget", "budget"), names).withColumns(
        {"full_epochs": F.expr("budget div available"), "rest": F.expr("budget % available")}
    )
    plan = materialize(plan, "mix-budgets")  # a row a leaf
    # Where the prefix ends: ranges of ranks it ends in, each within the one before, then the document.
    partial = plan.where("rest > 0").select(*names, "full_epochs", "rest")
    ranked = tokens.select("k", *names, "n_tokens").join(partial, names).withColumn("_rank", _rank(F.col("full_epochs"), c))
    found = partial.select(*names, F.lit("").alias("_range"), F.lit(0).cast("bigint").alias("_before"))
    up_to = Window.partitionBy(*names).orderBy("_range")
    for step in range(1, c.narrowings + 1):
        inside = ranked.withColumn("_range", F.substring("_rank", 1, c.digits * (step - 1))).join(found, [*names, "_range"])
        sums = inside.groupBy(*names, F.substring("_rank", 1, c.digits * step).alias("_range"), "rest", "_before").agg(F.sum("n_tokens").alias("n"))
        found = (
            sums.withColumn("_before", F.col("_before") + F.sum("n").over(up_to) - F.col("n"))
            .where("_before < rest and rest <= _before + n")
            .select(*names, "_range", "_before")
        )
        found = materialize(found, "mix-ranges")  # a row a leaf
    last = Window.partitionBy(*names).orderBy("_rank", "k").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        ranked.withColumn("_range", F.substring("_rank", 1, c.digits * c.narrowings))
        .join(found, [*names, "_range"])
        .withColumn("_upto", F.col("_before") + F.sum("n_tokens").over(last))
        .where("_upto - n_tokens < rest and rest <= _upto")
        .select(*names, F.struct(F.col("_rank").alias("r"), F.col("k")).alias("cut"), F.expr("rest - (_upto - n_tokens)").alias("cut_take"))
    )
    return plan.join(ends, names, "left")


def select_mix(tokens: DataFrame, plan: DataFrame, c: MixConfig = MixConfig()) -> DataFrame:
    """The rows of ``tokens`` (with all their columns) that the plan selects, once an epoch, with epoch and take_tokens.

    ``plan`` has a row a leaf; from a written table, so it is sent to all tasks only if
    its size is under Spark's own limit. Documents without words are never selected.
    """
    names = [f"_l{i}" for i in range(len(c.levels))]
    at = F.struct(_rank(F.col("full_epochs"), c).alias("r"), F.col("k"))
    last = F.when(at == F.col("cut"), F.col("cut_take")).when(at < F.col("cut"), F.col("n_tokens"))
    whole = F.transform(F.sequence(F.lit(1), F.col("full_epochs").cast("int"), F.lit(1)), lambda e: F.struct((e - 1).alias("epoch"), F.col("n_tokens").alias("take")))
    none = F.expr("cast(array() as array<struct<epoch:int,take:bigint>>)")
    picks = F.concat(
        F.when(F.col("full_epochs") > 0, whole).otherwise(none),
        F.when(last.isNotNull(), F.array(F.struct(F.col("full_epochs").cast("int").alias("epoch"), last.alias("take")))).otherwise(none),
    )
    chosen = tokens.where("n_tokens > 0").join(plan, names).withColumn("_pick", F.explode(picks))
    return chosen.select(*tokens.columns, F.col("_pick.epoch").alias("epoch"), F.col("_pick.take").alias("take_tokens"))


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", c: MixConfig = MixConfig()) -> DataFrame:
    """(key, the levels, n_tokens, epoch, take_tokens) of every selected document.

    A null level is the value "(none)". Repeated rows are separate documents of equal rank; a
    prefix that ends among them ends at all of them alike. A null or empty text has no
    tokens and is never selected. Without tokens nothing is selected.
    """
    tokens = materialize(counted(docs, key, text, c).drop("box"), "mix-tokens")
    plan = materialize(leaf_plan(tokens, c), "mix-plan")
    levels = [F.col(f"_l{i}").alias(x) for i, x in enumerate(c.levels)]
    return select_mix(tokens, plan, c).select(F.col("k").alias(key), *levels, "n_tokens", "epoch", "take_tokens")


def mix_sources_sql(c: MixConfig = MixConfig()) -> str:
    """DuckDB SQL with the rows of mix_sources over ``documents``."""

    def weight(level: str) -> str:
        cases = " ".join(f"WHEN '{v}' THEN {n}" for v, n in c.weights.get(level, {}).items())
        return f"CASE {level} {cases} ELSE 1 END" if cases else "1"

    none = " OR ".join(f"({weight(x)}) = 0" for x in c.levels)
    ctes, path = [], []
    ctes.append(f"""t AS (SELECT doc_id, 'domain' || (coalesce(TRY_CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT), 0) % 3) AS domain,
        coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
        len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS n_tokens FROM documents)""")
    keys = ", ".join(c.levels)
    ctes.append(f"leaf AS (SELECT {keys}, CAST(sum(n_tokens) AS BIGINT) AS available FROM t GROUP BY ALL HAVING sum(n_tokens) > 0)")
    ctes.append(f"b0 AS (SELECT CAST(sum(available) * {c.percent} // 100 AS BIGINT) AS budget FROM leaf)")
    for i, level in enumerate(c.levels):
        up, path = list(path), [*path, level]
        part = f"PARTITION BY {', '.join(up)} " if up else ""
        order = f"{part}ORDER BY coalesce(capacity::HUGEINT * 1000 // nullif(weight, 0), 0), {', '.join(path)}"
        source = f"JOIN b{i} USING ({', '.join(up)})" if up else "CROSS JOIN b0"
        ctes.append(f"""n{i} AS (SELECT *, budget - coalesce(sum(capacity) OVER (ORDER_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
            sum(weight) OVER (ORDER_ ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w, row_number() OVER (ORDER_) AS pos
            FROM (SELECT {', '.join(path)}, CAST(sum(CASE WHEN {none} THEN 0 ELSE available END) * {c.max_epochs} AS BIGINT) AS capacity, {weight(level)} AS weight
            FROM leaf GROUP BY {', '.join(path)}) {source})""".replace("ORDER_", order))
        ctes.append(f"""f{i} AS (SELECT *, min(CASE WHEN capacity * w > weight * room THEN pos END) OVER ({part}) AS stop FROM n{i})""")
        ctes.append(f"""b{i + 1} AS (SELECT {', '.join(path)}, CAST(CASE WHEN stop IS NULL OR pos < stop THEN capacity ELSE
            greatest(weight * max(CASE WHEN pos = stop THEN room END) OVER ({part}) // max(CASE WHEN pos = stop THEN w END) OVER ({part}), 0) END AS BIGINT) AS budget FROM f{i})""")
    ctes.append(f"plan AS (SELECT *, budget // available AS full_epochs, budget % available AS rest FROM leaf JOIN b{len(c.levels)} USING ({keys}))")
    ctes.append(f"""part AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {keys} ORDER BY md5('{c.seed}:' || full_epochs || ':' || doc_id), doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens AS before FROM t JOIN plan USING ({keys}) WHERE n_tokens > 0)""")
    return f"""WITH {", ".join(ctes)}
        SELECT doc_id, {keys}, n_tokens, CAST(epoch AS INTEGER) AS epoch, n_tokens AS take_tokens
        FROM (SELECT *, unnest(range(0, full_epochs)) AS epoch FROM part) UNION ALL
        SELECT doc_id, {keys}, n_tokens, CAST(full_epochs AS INTEGER) AS epoch, CAST(least(n_tokens, rest - before) AS BIGINT) AS take_tokens
        FROM part WHERE before < rest"""
