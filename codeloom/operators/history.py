"""Change history, hotspots, coverage evidence and usage telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.predicates import DEFECT
from codeloom.functions.scalars import basis_points, percent_points, rounded_deviation
from codeloom.operators.relational import pairs_within, ranks_over_values

DAY = 86_400
NOTICES = {"not_git": "not a repository", "no_git": "git is not installed", "shallow": "the clone is shallow"}


def history_notice(state: Column) -> Column:
    """Why there is no history; null where there is. Callers then go on with empty tables."""
    out = F.lit(None).cast("string")
    for k, v in NOTICES.items():
        out = F.when(state == k, f"no history: {v}").otherwise(out)
    return out


def last_sha(commits: DataFrame, order: str) -> str | None:
    """The cursor after these commits: the sha of the last one."""
    return commits.agg(F.max_by("sha", order)).first()[0]


def mined(stored: DataFrame, log: DataFrame, order: str, cursor: str | None) -> DataFrame:
    """Commits after a run over the log. With the cursor in the log only what comes after it is new; else all is mined again.

    ``stored`` has the columns of the result; a commit that is there already is replaced.
    """
    at = None if cursor is None else log.where(F.col("sha") == cursor).agg(F.max(order)).first()[0]
    if at is None:
        return log.select(*stored.columns).dropDuplicates(["sha"])
    new = log.where(F.col(order) > at).select(*stored.columns).dropDuplicates(["sha"])
    return stored.join(new.select("sha"), "sha", "left_anti").select(*stored.columns).unionByName(new)


def ingestible(reported: DataFrame, known: DataFrame, current: DataFrame) -> DataFrame:
    """Reported files (report, path, content_hash) of reports not taken in before, whose content is still what it was."""
    fresh = reported.join(known.select("report").distinct(), "report", "left_anti")
    return fresh.join(current.select("path", "content_hash"), ["path", "content_hash"], "left_semi")


def window_commits(commits: DataFrame, months: int | None = 12) -> DataFrame:
    """Commits since so many calendar months before the latest, with ``head_at``. None is no bound."""
    head = commits.agg(F.max("committed_at").alias("head_at"))  # one row
    both = commits.join(F.broadcast(head))
    if months is None:
        return both
    cutoff = F.unix_timestamp(F.timestamp_seconds("head_at") - F.expr(f"INTERVAL {int(months)} MONTH"))
    return both.where(F.col("committed_at") >= cutoff)


def file_history(commits: DataFrame, changes: DataFrame, months: int | None = 12, mega_commit: int = 50, defect: str = DEFECT) -> DataFrame:
    """Nine measures for each path changed in the window.

    Every change counts toward churn; commits with more than ``mega_commit`` files pair no
    files. Lines of binary files are null and count as 0. Authors are told apart by e-mail.
    """
    c = window_commits(commits, months)
    rows = changes.join(c, changes["commit_sha"] == c["sha"])
    age = F.greatest(F.lit(0), F.col("head_at") - F.col("committed_at"))
    base = rows.groupBy("path").agg(
        F.count("*").alias("commits"),
        F.sum(F.coalesce("added", F.lit(0))).alias("added"),
        F.sum(F.coalesce("deleted", F.lit(0))).alias("deleted"),
        F.floor(F.min(age) / DAY).alias("last_change_days"),
        rounded_deviation(age, DAY).alias("age_dispersion_days"),
        F.count_if(F.col("subject").rlike(defect)).alias("defects"),
    )
    by_author = rows.groupBy("path", "author_email").agg(F.count("*").alias("n"))
    total = by_author.groupBy("path").agg(F.sum("n").alias("t"), F.max("n").alias("top"), F.count("*").alias("k"))
    p = F.col("n") / F.col("t")
    entropy = by_author.join(total, "path").groupBy("path", "t", "top", "k").agg((-F.sum(p * F.log2(p))).alias("h"))
    owned = entropy.select(
        "path",
        basis_points(1 - F.col("top") / F.col("t")).alias("ownership_bp"),
        F.when(F.col("k") < 2, 0).otherwise(basis_points(F.col("h") / F.log2("k"))).cast("bigint").alias("entropy_bp"),
    )
    small = changes.join(c.where(F.col("file_count") <= mega_commit), changes["commit_sha"] == c["sha"], "left_semi")
    partners = pairs_within(small.select("commit_sha", "path").distinct(), "commit_sha", "path").groupBy(F.col("a").alias("path")).agg(F.countDistinct("b").alias("cochanged"))
    return base.join(owned, "path").join(partners, "path", "left").withColumn("cochanged", F.coalesce("cochanged", F.lit(0)))


def history_summary(measures: DataFrame) -> DataFrame:
    """One row: files, changes, the greatest churn, rounded means."""
    mean = lambda c: F.round(F.avg(c)).cast("bigint")
    return measures.agg(F.count("*").alias("files"), F.sum("commits").alias("changes"), F.max("commits").alias("max_churn"), mean("ownership_bp").alias("ownership_bp"), mean("entropy_bp").alias("entropy_bp"))


def hotspots(measures: DataFrame, complexity: DataFrame, coverage: DataFrame | None = None, test_only: DataFrame | None = None, untested: bool = False, most: int = 20) -> DataFrame:
    """Paths with both history and complexity by the product of their two ranks, highest first, ties by path.

    Files of tests alone go before ranking; ``untested`` keeps, after ranking, what has no
    fresh coverage above 0. ranked_files counts what was ranked and not filtered away.
    """
    both = measures.select("path", F.col("commits").alias("churn")).join(complexity.select("path", "cc"), "path")
    if test_only is not None:
        both = both.join(test_only.select("path"), "path", "left_anti")
    ranked = ranks_over_values(ranks_over_values(both, "churn", "churn_rank"), "cc", "cc_rank")
    ranked = ranked.withColumn("score", F.col("churn_rank") * F.col("cc_rank"))
    if coverage is not None:
        ranked = ranked.join(coverage.select("path", "state", "coverage_bp"), "path", "left").withColumn("state", F.coalesce("state", F.lit("n/a")))
        if untested:
            ranked = ranked.where((F.col("state") != "fresh") | (F.col("coverage_bp") == 0))
    n = ranked.agg(F.count("*").alias("ranked_files"))
    return ranked.orderBy(F.desc("score"), "path").limit(most).join(F.broadcast(n))  # one row


# Coverage


def merged_hits(lines: DataFrame, report: str) -> DataFrame:
    """Hits by file and line: the highest within a report, summed over reports."""
    return lines.groupBy("file_id", "line_no", report).agg(F.max("hits").alias("hits")).groupBy("file_id", "line_no").agg(F.sum("hits").alias("hits"))


def file_coverage(lines: DataFrame, covered_files: DataFrame, current: DataFrame) -> DataFrame:
    """(path, state, instrumented, covered, coverage_bp): fresh if the file is as it was, else stale and without a number."""
    counts = lines.groupBy("file_id").agg(F.count("*").alias("instrumented"), F.count_if(F.col("hits") > 0).alias("covered"))
    f = covered_files.join(current.select("path", F.col("content_hash").alias("now")), "path", "left").join(counts, F.col("id") == F.col("file_id"), "left")
    fresh = F.col("content_hash").eqNullSafe(F.col("now"))
    return f.select(
        "path",
        F.when(fresh, "fresh").otherwise("stale").alias("state"),
        F.coalesce("instrumented", F.lit(0)).alias("instrumented"),
        F.coalesce("covered", F.lit(0)).alias("covered"),
        F.when(fresh, percent_points(F.col("covered"), F.col("instrumented"))).alias("coverage_bp"),
    )


def overall_coverage(files: DataFrame) -> DataFrame:
    """(overall_bp, fresh_files, files): over fresh files; null if none of their lines is covered."""
    fresh = F.col("state") == "fresh"
    covered, lines = F.sum(F.when(fresh, F.col("covered"))), F.sum(F.when(fresh, F.col("instrumented")))
    return files.agg(F.when(covered > 0, percent_points(covered, lines)).alias("overall_bp"), F.count_if(fresh).alias("fresh_files"), F.count("*").alias("files"))


def mapped_paths(reported: DataFrame, indexed: DataFrame, strip: tuple[str, ...] = ()) -> DataFrame:
    """(reported, path): the longest indexed path that ends the reported one; else the only one that it ends; else null."""
    clean = F.regexp_replace(F.replace(F.col("reported"), F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    for prefix in sorted(strip, key=len, reverse=True):
        clean = F.when(clean.startswith(prefix.rstrip("/") + "/"), F.substring(clean, len(prefix.rstrip("/")) + 2, 1 << 20)).otherwise(clean)
    parts = F.split("clean", "/")
    tails = lambda col: F.transform(F.sequence(F.lit(1), F.size(col)), lambda i: F.array_join(F.slice(col, i, 1 << 20), "/"))
    r = reported.select("reported").distinct().withColumn("clean", clean)
    inner = r.select("reported", F.explode(tails(parts)).alias("path")).join(indexed.select("path"), "path").groupBy("reported").agg(F.max_by("path", F.length("path")).alias("path"))
    open_ = r.join(inner, "reported", "left_anti")
    ends = indexed.select("path", F.explode(tails(F.split("path", "/"))).alias("clean"))
    outer = open_.join(ends, "clean").groupBy("reported").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").select("reported", "path")
    return r.select("reported").join(inner.unionByName(outer), "reported", "left")


# Telemetry


def rolled_up(events: DataFrame) -> DataFrame:
    """Daily rows by surface and tool: calls, ok_calls, total and longest duration."""
    return events.groupBy(F.to_date(F.timestamp_seconds("happened_at")).cast("string").alias("day"), "surface", "tool").agg(
        F.count("*").alias("calls"), F.count_if("ok").alias("ok_calls"), F.sum("duration_ms").alias("total_duration_ms"), F.max("duration_ms").alias("max_duration_ms")
    )


def merged_rollups(one: DataFrame, two: DataFrame) -> DataFrame:
    both = one.unionByName(two)
    return both.groupBy("day", "surface", "tool").agg(*[F.sum(c).alias(c) for c in ("calls", "ok_calls", "total_duration_ms")], F.max("max_duration_ms").alias("max_duration_ms"))


def retained(events: DataFrame, rollup: DataFrame, now: Column | int, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """Events of the last days, and the rollup with what is older merged in."""
    old = F.col("happened_at") < F.lit(now) - days * DAY
    return events.where(~old), merged_rollups(rollup, rolled_up(events.where(old)))


def usage(events: DataFrame, rollup: DataFrame, cutoff: int) -> DataFrame:
    """(surface, tool, calls, ok_calls) since the cutoff, from both; without the surface ``web``."""
    day = F.to_date(F.timestamp_seconds(F.lit(cutoff))).cast("string")
    raw = events.where(F.col("happened_at") >= cutoff).select("surface", "tool", F.lit(1).alias("calls"), F.col("ok").cast("int").alias("ok_calls"))
    both = raw.unionAll(rollup.where(F.col("day") >= day).select("surface", "tool", "calls", "ok_calls")).where("surface <> 'web'")
    return both.groupBy("surface", "tool").agg(F.sum("calls").alias("calls"), F.sum("ok_calls").alias("ok_calls"))


def saved_reads(calls: DataFrame, weights: dict[str, int], tokens_per_read: int = 1500) -> DataFrame:
    """(reads, tokens): calls by what a call of the tool spares; tools without a weight spare nothing."""
    w = F.lit(0)
    for tool, n in weights.items():
        w = F.when(F.col("tool") == tool, n).otherwise(w)
    reads = F.coalesce(F.sum(F.col("calls") * w), F.lit(0))
    return calls.agg(reads.alias("reads"), (reads * tokens_per_read).alias("tokens"))
