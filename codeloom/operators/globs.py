"""Globs as data: rules with very many globs are matched by joins, and a plan doesn't grow with them.

A glob is looked up by what is literal in it: the folders before its first wildcard and the
extension after its last one. Paths meet globs under the folders they lie in and their own
extension, or the globs that name none, and only what meets is matched as a pattern.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.predicates import glob_pattern

WILD = re.compile(r"[*?\[{\\]")
ANY = "*"  # an extension that a glob leaves open


def literal_parts(glob: str) -> tuple[str, str]:
    """(folder, extension) that all paths of a glob have; the extension with its dot, or ANY."""
    wild = WILD.search(glob)
    folder = glob[: wild.start() if wild else len(glob)].rpartition("/")[0]
    name = re.split(r"[*?\]}/]", glob)[-1]
    open_ = wild and ("{" in glob or "[" in glob or "\\" in glob)
    return folder, ANY if open_ or "." not in name else "." + name.rpartition(".")[2]


def glob_table(spark, globs: list[str]) -> DataFrame:
    """(glob, pattern, folder, extension) of distinct globs."""
    rows = [(g, glob_pattern(g), *literal_parts(g)) for g in dict.fromkeys(globs)]
    return spark.createDataFrame(rows, "glob string, pattern string, folder string, extension string")


def glob_hits(paths: DataFrame, globs: list[str]) -> DataFrame:
    """(path, glob): which distinct globs match which distinct paths (path)."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    extension = F.regexp_extract(F.element_at(parts, -1), r"\.[^.]*$", 0)
    each = paths.where("path is not null").select("path").distinct().select("path", F.explode(folders).alias("folder"), extension.alias("own"))
    keyed = each.select("path", "folder", F.explode(F.array("own", F.lit(ANY))).alias("extension"))
    met = keyed.join(glob_table(paths.sparkSession, globs), ["folder", "extension"])
    return met.where(F.rlike("path", "pattern")).select("path", "glob")


def first_globs(paths: DataFrame, layers: list[tuple[str, list[str]]]) -> DataFrame:
    """(path, layer): the first layer, in the order given, one of whose globs matches; null where none does."""
    rows = [(g, i, name) for i, (name, globs) in enumerate(layers) for g in globs]
    order = paths.sparkSession.createDataFrame(rows, "glob string, place int, layer string")
    hits = glob_hits(paths, [g for g, _, _ in rows]).join(order, "glob").groupBy("path").agg(F.min_by("layer", "place").alias("layer"))
    return paths.select("path").distinct().join(hits, "path", "left")


def paired(edges: DataFrame, rules: list[tuple[str, str]], source: str = "source", target: str = "target") -> DataFrame:
    """(rule, and all columns of edges) of edges whose ends match both globs of a rule. Each end is matched once, whatever the rules and edges."""
    pairs = edges.sparkSession.createDataFrame([(f"{a} -> {b}", a, b) for a, b in dict.fromkeys(rules)], "rule string, from_glob string, to_glob string")
    a = glob_hits(edges.select(F.col(source).alias("path")), [a for a, _ in rules]).toDF(source, "from_glob")
    b = glob_hits(edges.select(F.col(target).alias("path")), [b for _, b in rules]).toDF(target, "to_glob")
    return edges.join(a, source).join(pairs, "from_glob").join(b, [target, "to_glob"]).select("rule", *edges.columns)
