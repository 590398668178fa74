"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by pattern. A value that occurs under many owners or in many
repositories is a copied example (documentation, licence texts, test fixtures); one that
stays with few and looks like key material is probably live. The verdict needs counts
over the whole corpus: distinct owners and repositories by hash of the value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import materialize

# Fixed patterns: kind, pattern, group of the value, least length of the value.
# Where a length bound inside the pattern finds the same spans as a filter on maximal
# matches would, it is written inside, since it spares the short matches.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("prefixed", r"gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}", 0, 16),
)
BASE = ("assign", "access", "hex")
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|xxxx|your"


@dataclass(frozen=True)
class OwnershipRule:
    """A value with at least so many owners or repositories is widely copied."""

    copied_owners: int = 3
    copied_repositories: int = 5
    live_distinct_characters: int = 8


def _running(lengths: Column) -> Column:
    """Sums up to and including each element, by doubling: about log2(n) passes over n elements."""
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(lengths), F.lit(1)))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))

    def add(sums: Column, d: Column) -> Column:
        moved = F.concat(F.array_repeat(F.lit(0), d), F.slice(sums, F.lit(1), F.size(sums) - d))
        return F.when(d < F.size(sums), F.zip_with(sums, moved, lambda a, b: a + b)).otherwise(sums)

    return F.reduce(steps, lengths, add)


def _found(matches: Column, values: Column, gaps: Column, kind: str, rank: int, least: int) -> Column:
    """Spans of one kind: each ends after all gaps up to its own and all matches with it."""
    lengths = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))
    rows = F.arrays_zip(matches.alias("m"), values.alias("v"), _running(lengths).alias("e"))

    def span(r: Column) -> Column:
        return F.struct(
            (r["e"] - F.length(r["m"])).alias("start"),
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"),
            r["e"].alias("end"),
            r["v"].alias("value"),
        )

    return F.filter(F.transform(rows, span), lambda s: F.length(s["value"]) >= least)


def candidates(docs: DataFrame, keep: list[Column], text: str) -> DataFrame:
    """``keep`` and ``found``: all spans of every text, by start, then kind. Positions are code points."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")
    names = [f"_keep{i}" for i in range(len(keep))]
    df = docs.select(*[c.alias(n) for c, n in zip(keep, names)], t.alias("_t"))
    plain = df.columns
    for kind, pattern, group, _ in KINDS:
        hit = F.col("_t").rlike(pattern)
        whole = F.when(hit, F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))).otherwise(none)
        df = df.withColumn(f"_{kind}", whole)
    cols = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        some = F.size(f"_{kind}") > 0
        values = F.regexp_extract_all("_t", F.lit(pattern), F.lit(group)) if group else F.col(f"_{kind}")
        df = df.withColumns(
            {
                f"_{kind}_v": F.when(some, values).otherwise(none),
                f"_{kind}_g": F.when(some, F.split("_t", pattern, -1)).otherwise(none),
            }
        )
        cols.append((rank, kind, least))
    spans = [_found(F.col(f"_{k}"), F.col(f"_{k}_v"), F.col(f"_{k}_g"), k, r, n) for r, k, n in cols]
    return df.select(*[F.col(n) for n in plain if n != "_t"], F.array_sort(F.concat(*spans)).alias("found"))


def looks_live(value: Column, rule: OwnershipRule) -> Column:
    return (
        value.rlike("[0-9]")
        & value.rlike("[A-Za-z]")
        & ~value.rlike(PLACEHOLDER)
        & (F.size(F.array_distinct(F.split(value, ""))) >= rule.live_distinct_characters)
    )


def written(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scan_secrets(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    owner: Column | None = None,
    repository: Column | None = None,
    rule: OwnershipRule = OwnershipRule(),
) -> DataFrame:
    """One row for each row of ``docs``: counts by kind, all spans, and how many are copied or live.

    Null and empty texts have no spans. A null owner or repository counts as none; the
    repository is source and language, null if either is. Repeated rows give repeated
    results and count as one owner. Spans of different kinds that overlap or start alike
    are all kept, by start, then kind. The work grows with the text and little faster than
    with the number of its spans.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat(F.col("source"), F.lit("/"), F.col("lang")) if repository is None else repository
    # Written once: the patterns run once over the texts, and the row number stays what it is.
    rows = materialize(
        candidates(docs, [F.col(key), owner, repository, F.monotonically_increasing_id()], text), "secret-candidates"
    ).withColumnsRenamed({"_keep0": key, "_keep3": "_row"})
    each = rows.select("_row", "_keep1", "_keep2", F.explode("found").alias("s")).select(
        "_row", "_keep1", "_keep2", F.col("s.value").alias("value"), F.sha2(F.col("s.value"), 256).alias("hash")
    )
    widely = (F.col("owners") >= rule.copied_owners) | (F.col("repositories") >= rule.copied_repositories)
    # Distinct first, so a value that is everywhere is a few rows a task before it meets in one.
    # Written, so that the join below reads both sides from exchanges and can split a hot value.
    copied = materialize(
        each.select("hash", "_keep1", "_keep2")
        .distinct()
        .groupBy("hash")
        .agg(F.countDistinct("_keep1").alias("owners"), F.countDistinct("_keep2").alias("repositories"))
        .where(widely)
        .select("hash", F.lit(True).alias("copied")),
        "secret-owners",
    )
    verdict = (
        each.join(copied, "hash", "left")
        .groupBy("_row")
        .agg(
            F.count("copied").alias("n_copied"),
            F.count_if(F.col("copied").isNull() & looks_live(F.col("value"), rule)).alias("n_live"),
        )
    )
    base = F.filter("found", lambda s: s["kind"] != "prefixed")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return rows.join(verdict, "_row", "left").select(
        key,
        *[count(k).alias(f"n_{k}") for k, *_ in KINDS],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
    )


def scan_secrets_sql(rule: OwnershipRule = OwnershipRule()) -> str:
    """DuckDB SQL with the rows of scan_secrets over ``documents``, where no two rows are alike."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    each = " UNION ALL ".join(
        f"""SELECT doc_id, source, lang, '{kind}' AS kind, {rank} AS rank, m[i] AS hit, v[i] AS value,
        CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, source, lang,
        regexp_extract_all(t, {quote(pattern)}) AS m, regexp_extract_all(t, {quote(pattern)}, {group}) AS v,
        string_split_regex(t, {quote(pattern)}) AS g FROM docs)) WHERE length(v[i]) >= {least}"""
        for rank, (kind, pattern, group, least) in enumerate(KINDS)
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, *_ in KINDS)
    return f"""WITH docs AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents), found AS ({each}),
    owners AS (SELECT value, count(DISTINCT source) >= {rule.copied_owners}
        OR count(DISTINCT source || '/' || lang) >= {rule.copied_repositories} AS copied FROM found GROUP BY value),
    by_doc AS (SELECT doc_id, {counts},
        string_agg(kind || ':' || s || ':' || (s + length(hit)), ',' ORDER BY s, rank) FILTER (kind <> 'prefixed') AS base,
        string_agg(kind || ':' || s || ':' || (s + length(hit)), ',' ORDER BY s, rank) AS spans,
        count(*) FILTER (copied) AS n_copied,
        count(*) FILTER (NOT copied AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
            AND NOT regexp_matches(value, {quote(PLACEHOLDER)})
            AND len(list_distinct(string_split(value, ''))) >= {rule.live_distinct_characters}) AS n_live
        FROM found JOIN owners USING (value) GROUP BY doc_id)
    SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, *_ in KINDS)}, sha256(coalesce(base, '')) AS base_sha256,
        coalesce(spans, '') AS spans, coalesce(n_copied, 0) AS n_copied, coalesce(n_live, 0) AS n_live
    FROM docs LEFT JOIN by_doc USING (doc_id)"""
