"""Scalar columns: paths, names, keys, ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def directory(path: Column) -> Column:
    """What is before the last separator; '' for a file at the root, '<unbound>' for no file."""
    return F.coalesce(F.when(path.rlike(r"[/\\]"), F.regexp_replace(path, r"[/\\][^/\\]*$", "")).otherwise(F.when(path.isNotNull(), "")), F.lit("<unbound>"))


def basis_points(share: Column) -> Column:
    """A ratio as whole ten-thousandths, halves away from zero."""
    return F.round(share * 10000).cast("bigint")


def percent_points(part: Column, whole: Column) -> Column:
    """part / whole in ten-thousandths by whole-number rounding; null where whole is 0."""
    return F.when(whole > 0, F.floor((part * 20000 + whole) / (whole * 2))).cast("bigint")


def rounded_deviation(whole: Column, unit: int) -> Column:
    """The standard deviation of a group's whole numbers in units, rounded with halves upwards; 0 of one.

    By whole numbers, so that a deviation of exactly a half is not decided by the order of a
    sum of floating-point numbers.
    """
    big = lambda c: c.cast("decimal(38,0)")
    n = big(F.count(whole))
    spread = big(big(n * big(F.sum(big(whole) * big(whole)))) - big(big(F.sum(whole)) * big(F.sum(whole))))  # n² times the variance
    near = F.floor(F.sqrt(spread.cast("double")) / n.cast("double") / unit + 0.5).cast("bigint")
    fits = lambda r: big(big(big(2 * r - 1) * big(2 * r - 1)) * big(big(n * n) * F.lit(unit * unit))) <= big(spread * F.lit(4))
    return F.when(fits(near + 1), near + 1).when((near > 0) & ~fits(near), near - 1).otherwise(near)


def slug(heading: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(heading)), r"[^a-z0-9 _-]", ""), " ", "-")


def identifier_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+"), F.lit(0))


def route_key(name: Column) -> Column:
    """'METHOD template' with the method in capitals and all parameters as {}; null for catch-alls and patterns."""
    method = F.upper(F.regexp_extract(name, r"^([A-Za-z]+)\s+(/.*)$", 1))
    template = F.regexp_extract(name, r"^([A-Za-z]+)\s+(/.*)$", 2)
    plain = F.regexp_replace(F.regexp_replace(template, r"\{[^}/*]+\}|:[A-Za-z_]\w*|<[^>/]+>", "{}"), r"(.)/$", "$1")
    bad = (method == "") | template.rlike(r"[*()\[\]^$]|\{[^}]*\*[^}]*\}")
    return F.when(~bad, F.concat_ws(" ", method, plain))


def client_call(slots: Column) -> Column:
    """struct(target, refusal) of an HTTP client's call, from a map of what was read off its site.

    ``method`` and ``path`` hold the words as written; ``path_dynamic`` says that the path is
    put together at run time. Only an absolute path that has a route key is a target.
    """
    slot = lambda name: F.nullif(F.trim(F.try_element_at(slots, F.lit(name))), F.lit(""))
    method, path = slot("method"), slot("path")
    dynamic = method.isNull() | F.map_contains_key(slots, "path_dynamic") | path.isNull() | ~F.startswith(path, F.lit("/"))
    target = F.concat_ws(" ", F.upper(method), path)
    refusal = F.when(F.coalesce(dynamic, F.lit(True)), "base-url-runtime").when(route_key(target).isNull(), "path-not-composed")
    return F.struct(F.when(refusal.isNull(), target).alias("target"), refusal.alias("refusal"))


def grpc_key(package: Column, service: Column, method: Column) -> Column:
    ok = package.rlike(r"^[A-Za-z_][\w.]*$") & service.rlike(r"^[A-Za-z_]\w*$") & method.rlike(r"^[A-Za-z_]\w*$")
    return F.when(ok, F.concat(package, F.lit("."), service, F.lit("/"), method))


def escaped_name(name: Column) -> Column:
    """A symbol's name, in back quotes (doubled inside) unless it is plain."""
    return F.when(name.rlike(r"^[A-Za-z0-9_+$-]+$"), name).otherwise(F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`")))


def short_title(text: Column, most: int = 60) -> Column:
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most), F.lit("…"))).otherwise(one)


def module_key(path: Column) -> Column:
    """Path parts below the source root; mod, lib and main stand for their folder."""
    below = F.regexp_replace(path, r"^(.*/)?src/", "")
    return F.regexp_replace(F.regexp_replace(below, r"\.[^./]+$", ""), r"(^|/)(mod|lib|main)$", "")


def folded_path(path: Column) -> Column:
    """A relative path without '.' and '..' parts; null where it leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts,
        F.expr("cast(array() AS array<string>)"),
        lambda a, p: F.when((p == "..") & (F.size(a) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), a), -1) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))),
    )
    return F.when(~F.array_contains(folded, ".."), F.array_join(folded, "/"))
