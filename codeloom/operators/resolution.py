"""References from text to nodes, and contracts between repositories.

A reference goes down a ladder of tiers. The first tier with a candidate decides: with
exactly one the reference is bound, with more it stays unbound, and later tiers are not
asked. Nothing is ever guessed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.predicates import CONFIG_KINDS, TYPE_KINDS, is_external, matches_glob
from codeloom.functions.scalars import client_call, folded_path, route_key
from codeloom.operators.graph import nearest_ancestor
from codeloom.operators.shared import cut
from codeloom.operators.traverse import CUT_EVERY, reach

POLICIES = ("strict", "balanced", "aggressive")  # fixed values; each allows more than the one before
MOST_ALIASES = 8  # that a path is led through, one after the other
DEALT = 32  # tasks that a folder's references are dealt to
AFTER_SCOPES = 1 << 24  # tiers of names begin here behind those of the scopes around them, however many


def decided(candidates: DataFrame) -> DataFrame:
    """(ref, node, outcome, tier) from rows (ref, tier, node): the lowest tier of a reference decides."""
    by = candidates.select("ref", "tier", "node").distinct().groupBy("ref", "tier").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    first = by.groupBy("ref").agg(F.min_by(F.struct("n", "node", "tier"), "tier").alias("d"))
    one = F.col("d.n") == 1
    return first.select("ref", F.when(one, F.col("d.node")).alias("node"), F.when(one, "bound").otherwise("ambiguous").alias("outcome"), F.col("d.tier").alias("tier"))


def ladder(candidates: list[DataFrame]) -> DataFrame:
    """decided() of tables (ref, node), one for each tier in order."""
    return decided(reduce(DataFrame.unionByName, [c.select("ref", F.lit(i).alias("tier"), "node") for i, c in enumerate(candidates)]))


def resolved(refs: DataFrame, candidates: list[DataFrame]) -> DataFrame:
    """Every reference with node, outcome and tier; ``not_found`` where no tier has a candidate."""
    found = ladder(candidates)
    return refs.join(found, refs["id"] == found["ref"], "left").drop("ref").withColumn("outcome", F.coalesce("outcome", F.lit("not_found")))


def by_key(refs: DataFrame, nodes: DataFrame, ref_key: Column, node_key: Column) -> DataFrame:
    """(ref, node) of equal keys."""
    r = refs.select(F.col("id").alias("ref"), ref_key.alias("k")).where("k is not null")
    return r.join(nodes.select(F.col("id").alias("node"), node_key.alias("k")), "k").select("ref", "node")


def keyed(refs: DataFrame, nodes: DataFrame, ref_key: Column, node_key: Column) -> DataFrame:
    """(ref, node) of equal keys, of the nodes under a key the least and the greatest, which may be one.

    That is enough for decided(), and nodes are grouped before they meet references, so a
    key that very many have is one row.
    """
    r = refs.select(F.col("id").alias("ref"), ref_key.alias("k")).where("k is not null")
    by = nodes.select(F.col("id").alias("node"), node_key.alias("k")).where("k is not null").groupBy("k").agg(F.min("node").alias("least"), F.max("node").alias("greatest"))
    return r.join(by, "k").select("ref", F.explode(F.array_distinct(F.array("least", "greatest"))).alias("node"))


def rebound(resolved_refs: DataFrame, promoted_nodes: DataFrame, ref_key: Column, node_key: Column) -> DataFrame:
    """A second pass, after nodes were promoted: references that found nothing are looked up among those; the others stay."""
    open_ = resolved_refs.where("outcome = 'not_found'").drop("node", "outcome", "tier")
    again = resolved(open_, [keyed(open_, promoted_nodes, ref_key, node_key)])
    return resolved_refs.where("outcome <> 'not_found'").unionByName(again.select(*resolved_refs.columns))


def by_suffix(refs: DataFrame, nodes: DataFrame, target: str, path: str) -> DataFrame:
    """(ref, node) where the target's parts are the last of the node's path."""
    parts = F.split(F.col(path), "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, 1 << 20), "/"))
    n = nodes.where(F.col(path).isNotNull()).select(F.col("id").alias("node"), F.explode(tails).alias("k"))
    return refs.select(F.col("id").alias("ref"), F.col(target).alias("k")).join(n, "k").select("ref", "node")


def _words(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, name): the names in a target."""
    return rows.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"[A-Za-z0-9_]+"), F.lit(0)))).alias("name"))


def affected(refs: DataFrame, target: str, dirty: DataFrame) -> DataFrame:
    """References with a name among the dirty ones."""
    words = _words(refs, refs.columns, target)
    return words.join(dirty.select("name"), "name", "left_semi").select(*refs.columns).distinct()


def delta_affected(refs: DataFrame, dirty: DataFrame, changed: DataFrame, aliases: DataFrame) -> DataFrame:
    """(ref, reason) of references (ref, file, target, kind) that a sync may bind anew; the others keep what they have.

    In order: they lie in a changed file (file); they are references of artifacts
    (artifact); a dirty name (name) is in their target (name); or their target begins with an
    alias (file, alias, target) of their file that leads to a dirty name within
    MOST_ALIASES steps (alias). Aliases are followed backwards, from those whose own target
    has a dirty name, so a step costs what it finds.
    """
    head = lambda c: F.regexp_extract(c, r"^[^:]*", 0)
    names = dirty.select("name").distinct()
    known = cut(aliases.select("file", "alias", "target").distinct())
    found = front = cut(_words(known, ["file", "alias"], "target").join(names, "name", "left_semi").select("file", "alias").distinct())
    for _ in range(MOST_ALIASES - 1):
        if front.isEmpty():
            break
        step = known.select("file", "alias", head(F.col("target")).alias("head")).join(front.withColumnRenamed("alias", "head"), ["file", "head"], "left_semi")
        front = cut(step.select("file", "alias").distinct().join(found, ["file", "alias"], "left_anti"))
        found = found.union(front)
    own = refs.select("ref", "file", "target", "kind")
    reasons = [
        own.join(changed.select("file").distinct(), "file", "left_semi").select("ref", F.lit(0).alias("reason")),
        own.where(F.col("kind").isin("artifact_ref", "artifact_binding")).select("ref", F.lit(1)),
        _words(own, ["ref"], "target").join(names, "name", "left_semi").select("ref", F.lit(2)),
        own.select("ref", "file", head(F.col("target")).alias("alias")).join(found, ["file", "alias"], "left_semi").select("ref", F.lit(3)),
    ]
    first = reduce(DataFrame.union, reasons).groupBy("ref").agg(F.min("reason").alias("reason"))
    return first.select("ref", F.element_at(F.array(*[F.lit(x) for x in ("file", "artifact", "name", "alias")]), F.col("reason") + 1).alias("reason"))


def artifact_outcomes(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref, node, outcome) of artifact references (ref, file, target, kind, form, relation, want_kind) to nodes (id, kind, name, file_path).

    A reference is looked up by what it is: a path (from its own folder, else from the
    root) is the only configuration file there; a terraform module's path stands for all
    files .tf in the folder, a row each; a name is the only node of the wanted kind, or of any
    configuration kind; a binding by name is the only type of that name; one by path the
    only route with that key. Several are ``ambiguous``, but for the folder; none is
    ``not_found``.
    """
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    at = lambda rows, tier, path, how: rows.select("ref", F.lit(tier).alias("tier"), path.alias("key"), F.lit(how).alias("how"))
    paths = refs.where("kind = 'artifact_ref' and form = 'path' and file is not null")
    own, root = folded_path(F.concat_ws("/", F.nullif(folder(F.col("file")), F.lit("")), F.col("target"))), folded_path(F.col("target"))
    is_dir = F.coalesce(F.col("relation") == "tf_module_call", F.lit(False))
    names = refs.where("form = 'method'")
    asked = [
        at(paths.where(~is_dir), 0, own, "file"), at(paths.where(~is_dir), 1, root, "file"), at(paths.where(is_dir), 0, own, "folder"), at(paths.where(is_dir), 1, root, "folder"),
        at(names.where("kind = 'artifact_ref'"), 0, F.concat_ws("\n", F.coalesce("want_kind", F.lit("any")), "target"), "name"),
        at(names.where("kind = 'artifact_binding'"), 0, F.col("target"), "type"),
        at(refs.where("kind = 'artifact_binding' and form = 'path'"), 0, route_key(F.col("target")), "route"),
    ]
    config = nodes.where("kind = 'config_file' and file_path is not null")
    to = lambda rows, key, how: rows.select(key.alias("key"), F.lit(how).alias("how"), F.col("id").alias("node"))
    kept = [
        to(config, F.col("file_path"), "file"), to(config.where("file_path like '%.tf'"), folder(F.col("file_path")), "folder"),
        to(nodes, F.concat_ws("\n", "kind", "name"), "name"), to(nodes.where(F.col("kind").isin(*CONFIG_KINDS)), F.concat(F.lit("any\n"), F.col("name")), "name"),
        to(nodes.where(F.col("kind").isin(*TYPE_KINDS)), F.col("name"), "type"), to(nodes.where("kind = 'route'"), route_key(F.col("name")), "route"),
    ]
    kept = cut(reduce(DataFrame.unionByName, kept).distinct())
    # Nodes are grouped before they meet references: the least and the greatest tell one from several.
    by = kept.groupBy("key", "how").agg(F.min("node").alias("least"), F.max("node").alias("greatest"))
    hits = cut(reduce(DataFrame.unionByName, asked).distinct().join(by, ["key", "how"]))
    first = hits.groupBy("ref").agg(F.min("tier").alias("tier"))
    hits = hits.join(first, ["ref", "tier"])
    # A folder may have very many references and files, so both are dealt to several tasks: references to one, files to all.
    files = kept.where("how = 'folder'").select("key", "node", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("deal"))
    many = hits.where("how = 'folder'").select("ref", "key", F.pmod(F.xxhash64("ref"), F.lit(DEALT)).cast("int").alias("deal"))
    many = many.join(files, ["key", "deal"]).select("ref", "node", F.lit("bound").alias("outcome"))
    one = hits.where("how <> 'folder'").groupBy("ref").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    same = F.col("least") == F.col("greatest")
    one = one.select("ref", F.when(same, F.col("least")).alias("node"), F.when(same, "bound").otherwise("ambiguous").alias("outcome"))
    found = first.select(F.col("ref").alias("hit"))
    none = refs.select("ref").join(found, F.col("ref") == F.col("hit"), "left_anti").select("ref", F.lit(None).cast(nodes.schema["id"].dataType).alias("node"), F.lit("not_found").alias("outcome"))
    return many.unionByName(one).unionByName(none)


def relation_coverage(resolved_refs: DataFrame) -> DataFrame:
    """(payload, bound, unresolved) of references with a payload."""
    bound = F.col("outcome") == "bound"
    return resolved_refs.where("payload is not null").groupBy("payload").agg(F.count_if(bound).alias("bound"), F.count_if(~bound).alias("unresolved"))


def resolution_ratio(resolved_refs: DataFrame) -> DataFrame:
    """(ratio): bound references of all; 1 without references."""
    return resolved_refs.agg(F.coalesce(F.avg((F.col("outcome") == "bound").cast("double")), F.lit(1.0)).alias("ratio"))


def promoted(names: DataFrame, kind: str, offset: int = 0) -> DataFrame:
    """(symbol, kind, name, members): a node for each distinct name, first members counted once."""
    return names.groupBy("name").agg(F.countDistinct("member").alias("members")).select(F.concat(F.lit(f"{kind}/"), F.col("name")).alias("symbol"), F.lit(kind).alias("kind"), "name", "members")


def doc_kind(path: Column, heading: Column) -> Column:
    """The typed kind of a documentation node: a file (no heading) by its path, a section by its heading.

    A requirement lies directly in a folder ``requirements`` and is named FR- or NFR-; a
    decision is named ADR- and a digit, wherever it lies; a story is headed S-, digits, and
    then a colon, white space or nothing.
    """
    markdown = r"[^/]*\.(md|markdown)$"
    return (
        F.when(heading.rlike(r"^\s*S-\d+(:|\s|$)"), "story")
        .when(heading.isNotNull(), "doc_section")
        .when(path.rlike(r"(^|/)requirements/(FR|NFR)-" + markdown), "requirement")
        .when(path.rlike(r"(^|/)ADR-\d" + markdown), "decision")
        .otherwise("doc_file")
    )


# Paths and names


@dataclass(frozen=True)
class Index:
    """What references are looked up in. Module paths are parts joined by '::', '' for the root of a crate."""

    modules: DataFrame  # crate, path, node
    members: DataFrame  # crate, path (of the module), name, node, callable, type_like
    aliases: DataFrame  # file, alias, target
    globs: DataFrame  # file, target


def binding_index(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Tables (key, node): nodes by symbol, name, file path, route key and module key, members by scope, implementors by trait."""
    key = lambda c, rows=nodes: rows.select(c.alias("key"), F.col("id").alias("node")).where("key is not null")
    inside = lambda kind: edges.where(F.col("kind") == kind).select(F.col("source").cast("string").alias("key"), F.col("target").alias("node"))
    return {
        "symbol": key(F.col("symbol")),
        "name": key(F.col("name")),
        "file": key(F.col("file_path")),
        "route": key(F.when(F.col("kind") == "route", route_key(F.col("name")))),
        "module": key(F.when(F.col("kind") == "module", F.lower("name"))),
        "scope": inside("contains"),
        "implements": inside("implements"),
    }


def _joined(*parts: Column) -> Column:
    """Paths put together; empty ones don't count."""
    return F.concat_ws("::", *[F.when(p != "", p) for p in parts])


def descend(paths: DataFrame, ix: Index) -> DataFrame:
    """(ref, tier, node) of paths (ref, tier, crate, full, want) from a crate's root.

    The last part is a module (unless something callable is wanted), else a member of the
    module before it; where a type stands before it, a callable member of the type's module.
    """
    part = F.split("full", "::")
    last, base = F.element_at(part, -1), F.array_join(F.slice(part, 1, F.size(part) - 1), "::")
    p = paths.where("crate is not null and full is not null").withColumns({"name": last, "path": base, "tier": F.col("tier") * 3})
    module = p.where("want <> 'callable'").join(ix.modules.withColumnRenamed("path", "full"), ["crate", "full"]).select("ref", "tier", "node")
    rest = p.where("want <> 'module'")
    admitted = F.expr("want <> 'callable' or callable")
    member = rest.join(ix.members, ["crate", "path", "name"]).where(admitted).select("ref", (F.col("tier") + 1).alias("tier"), "node")
    typed = ix.members.where("type_like").select("crate", _joined(F.col("path"), F.col("name")).alias("path"), F.col("path").alias("home")).distinct()
    collapsed = rest.join(typed, ["crate", "path"]).select("ref", "tier", "crate", F.col("home").alias("path"), "name").join(ix.members.where("callable"), ["crate", "path", "name"])
    return module.unionByName(member).unionByName(collapsed.select("ref", (F.col("tier") + 2).alias("tier"), "node"))


def _from_root(refs: DataFrame) -> DataFrame:
    """(ref, tier, crate, full, want) of paths by their head: crate, self, super, a crate's name, or relative."""
    part = F.split("target", "::")
    head, rest = part[0], F.array_join(F.slice(part, 2, 1 << 20), "::")
    supers = F.size(part) - F.size(F.slice(part, F.greatest(F.array_position(F.transform(part, lambda x: x != "super"), True), F.lit(1)).cast("int"), 1 << 20))
    own = F.filter(F.split("path", "::"), lambda x: x != "")
    above = F.array_join(F.slice(own, 1, F.greatest(F.size(own) - supers, F.lit(0))), "::")
    below = F.array_join(F.slice(part, supers + 1, 1 << 20), "::")
    place = lambda tier, crate, full: F.struct(F.lit(tier).alias("t"), crate.alias("c"), full.alias("f"))
    named = F.array(
        place(5, F.replace(head, F.lit("-"), F.lit("_")), rest),
        place(6, F.col("crate"), _joined(F.col("path"), F.col("target"))),
        place(7, F.col("crate"), F.col("target")),
    )
    places = (
        F.when(head == "crate", F.array(place(1, F.col("crate"), rest)))
        .when(head == "self", F.array(place(2, F.col("crate"), _joined(F.col("path"), rest))))
        .when((head == "super") & (supers <= F.size(own)), F.array(place(3, F.col("crate"), _joined(above, below))))
        .when(head == "super", F.slice(named, 1, 0))
        .otherwise(named)
    )
    found = refs.select("ref", "tier", "want", F.explode(places).alias("p"))
    return found.select("ref", (F.col("tier") + F.col("p.t")).alias("tier"), F.col("p.c").alias("crate"), F.col("p.f").alias("full"), "want")


def glob_modules(refs: DataFrame, ix: Index) -> DataFrame:
    """(file, crate, path) of modules that a file imports whole; ``refs`` say which crate and module a file is in."""
    files = refs.select("file", "crate", "path").distinct()
    globs = ix.globs.join(files, "file").withColumn("ref", F.struct("file", "crate", "path", "target")).select("ref", F.lit(0).alias("tier"), "crate", "path", "target", F.lit("module").alias("want"))
    found = decided(descend(_from_root(globs), ix)).where("outcome = 'bound'")
    return found.join(ix.modules, "node").select(F.col("ref.file").alias("file"), F.col("ref.crate").alias("from_crate"), F.col("ref.path").alias("from_path"), "crate", "path")


def path_candidates(refs: DataFrame, ix: Index, policy: str = "balanced") -> DataFrame:
    """(ref, tier, node) of paths with '::' from refs (ref, file, crate, path, target, want); want is any, callable or module.

    In order: from the crate's root, the own module or those above; what an alias of the
    file stands for (as far as aliases lead, the farthest first); from a named crate; from
    the own module, then the own crate's root; through modules the file imports whole;
    unless strict, the only item whose module path ends alike, in the crate, then anywhere.
    """
    # Cut from their past: every step is used several times below.
    steps = [cut(refs.select("ref", "file", "crate", "path", "target", "want").withColumn("tier", F.lit(MOST_ALIASES * 20)))]
    for depth in range(1, MOST_ALIASES + 1):
        now = steps[-1].withColumn("alias", F.regexp_extract("target", r"^[^:]*", 0)).join(ix.aliases.withColumnRenamed("target", "to"), ["file", "alias"])
        now = now.where("alias not in ('crate', 'self', 'super')").withColumn("target", F.concat("to", F.expr("substring(target, length(alias) + 1)")))
        now = cut(now.select(*steps[0].columns[:-1], F.lit((MOST_ALIASES - depth) * 20).alias("tier")))
        if now.isEmpty():
            break  # no alias leads further
        steps.append(now)
    every = reduce(DataFrame.unionByName, steps)
    found = descend(_from_root(every), ix)
    open_ = every.where("not target rlike '^(crate|self|super)(::|$)'")
    whole = cut(glob_modules(refs, ix))
    through = open_.join(whole.select("file", F.col("from_crate").alias("crate"), F.col("from_path").alias("path"), F.col("crate").alias("c"), F.col("path").alias("p")), ["file", "crate", "path"])
    through = through.select("ref", (F.col("tier") + 8).alias("tier"), F.col("c").alias("crate"), _joined(F.col("p"), F.col("target")).alias("full"), "want")
    found = found.unionByName(descend(through, ix))
    if policy == "strict":
        return found
    part = F.split("target", "::")
    ends = open_.where(F.size(part) > 1).select("ref", "tier", "crate", "want", F.element_at(part, -1).alias("name"), F.array_join(F.slice(part, 1, F.size(part) - 1), "::").alias("end"))
    parts = F.split("path", "::")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, 1 << 20), "::"))
    members = ix.members.where("path <> ''").select("crate", "name", F.explode(tails).alias("end"), "node", "callable")
    near = first_and_last(ends, members, ["crate", "name", "end"]).select("ref", ((F.col("tier") + 9) * 3).alias("tier"), "node")
    return found.unionByName(near).unionByName(first_and_last(ends, members, ["name", "end"]).select("ref", ((F.col("tier") + 10) * 3).alias("tier"), "node"))


def allowed(candidates: DataFrame, policy: str) -> DataFrame:
    """Of path_candidates() or name_candidates() under the widest policy those that another allows, without looking again.

    Names under ``strict`` are asked for anew, since it is asked of their aliases, too.
    """
    among_scopes = F.col("tier") >= AFTER_SCOPES
    alike = F.when(among_scopes, F.col("tier") >= AFTER_SCOPES + 5).otherwise((policy == "strict") & (F.col("tier") % 60 >= 27))
    return candidates if policy == "aggressive" else candidates.where(~alike)


def first_and_last(refs: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """(ref, tier, node) of refs (ref, tier, want, keys): of the members under their keys the least and the greatest, which may be one.

    That is enough to tell none, one and several apart, and members are grouped before they
    meet references, so a name that very many have is one row.
    """
    of = lambda c: F.array_distinct(F.array(F.min(c), F.max(c)))
    by = members.groupBy(*keys).agg(of(F.col("node")).alias("any"), of(F.when(F.col("callable"), F.col("node"))).alias("calls"))
    node = F.explode(F.array_compact(F.when(F.col("want") == "callable", F.col("calls")).otherwise(F.col("any"))))
    return refs.join(by, keys).select("ref", "tier", node.alias("node"))


def name_candidates(refs: DataFrame, ix: Index, nodes: DataFrame, edges: DataFrame, policy: str = "balanced") -> DataFrame:
    """(ref, tier, node) of single names from refs (ref, source, file, crate, path, target, want).

    In order: members of the source, then of each scope around it up to the outermost, where
    a call of a bare name (``want`` callable, unless a column ``bare`` says otherwise, as
    for a method of an unknown receiver) takes free functions before methods; a child module or a
    module of the crate's root, or a crate; what an alias of the file stands for; members
    of modules the file imports whole; if aggressive, the only item of the name, in the
    crate, then anywhere.
    """
    inside = edges.where("kind = 'contains'").select(F.col("source").alias("scope"), F.col("target").alias("node"))
    parent = cut(inside.groupBy(F.col("node").alias("child")).agg(F.min("scope").alias("parent")))
    kind = nodes.select(F.col("id").alias("node"), F.col("name").alias("target"), F.col("kind").isin("function", "method").alias("callable"), (F.col("kind") == "function").alias("free"))
    named = cut(inside.join(kind, "node"))
    admitted = F.expr("want <> 'callable' or callable")
    bare = F.col("bare") if "bare" in refs.columns else F.col("want") == "callable"
    # Who asks for a name that nothing inside a scope has needn't look; who has found it needn't look further out.
    scope = refs.select("ref", "target", "want", bare.alias("bare"), F.col("source").alias("scope"), F.col("source").alias("mark"))
    scope = cut(scope.join(named.select("target").distinct(), "target", "left_semi").select(*scope.columns))
    found, depth = [], 0
    while True:
        here = cut(scope.join(named, ["scope", "target"]).where(admitted).select("ref", F.lit(depth).alias("tier"), "node", "bare", "free"))
        if not (depth and here.isEmpty()):
            found.append(here)
        depth += 1
        if len(found) > CUT_EVERY:
            found = [cut(reduce(DataFrame.unionByName, found))]
        mark = F.col("scope") if depth & (depth - 1) == 0 else F.col("mark")  # who comes to a mark again is on a cycle
        scope = scope.join(here.select("ref").distinct(), "ref", "left_anti")
        scope = scope.withColumn("mark", mark).join(parent, F.col("scope") == F.col("child")).where("parent <> mark")
        scope = cut(scope.select("ref", "target", "want", "bare", F.col("parent").alias("scope"), "mark"))
        if scope.isEmpty():
            break
    lexical = reduce(DataFrame.unionByName, found).withColumn("any_free", F.max("free").over(Window.partitionBy("ref", "tier")))
    parts = [lexical.where("free or not bare or not any_free").select("ref", "tier", "node")]
    at = AFTER_SCOPES
    modules = refs.where("want <> 'callable'")
    child = modules.select("ref", "crate", _joined(F.col("path"), F.col("target")).alias("path"), F.lit(at).alias("tier"))
    child = child.union(modules.select("ref", "crate", "target", F.lit(at + 1))).union(modules.select("ref", F.replace("target", F.lit("-"), F.lit("_")), F.lit(""), F.lit(at + 2)))
    parts.append(child.join(ix.modules, ["crate", "path"]).select("ref", "tier", "node"))
    alias = refs.join(ix.aliases.select("file", F.col("alias").alias("target"), F.col("target").alias("to")), ["file", "target"])
    alias = path_candidates(alias.select("ref", "file", "crate", "path", F.col("to").alias("target"), "want"), ix, policy)
    parts.append(decided(alias).where("outcome = 'bound'").select("ref", F.lit(at + 3).alias("tier"), "node"))
    whole = glob_modules(refs, ix).select("file", F.col("from_crate").alias("crate"), F.col("from_path").alias("path"), F.col("crate").alias("c"), F.col("path").alias("p"))
    through = refs.join(whole, ["file", "crate", "path"]).select("ref", F.lit(at + 4).alias("tier"), F.col("c").alias("crate"), _joined(F.col("p"), F.col("target")).alias("full"), "want")
    parts.append(descend(through, ix).select("ref", F.lit(at + 4).alias("tier"), "node"))
    if policy == "aggressive":
        alike = refs.select("ref", "crate", F.col("target").alias("name"), "want")
        parts.append(first_and_last(alike.withColumn("tier", F.lit(at + 5)), ix.members, ["crate", "name"]))
        parts.append(first_and_last(alike.withColumn("tier", F.lit(at + 6)), ix.members, ["name"]))
    return reduce(DataFrame.unionByName, parts)


def member_access(refs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ref, node, outcome) of refs (ref, source, field): the only field of that name in the nearest class-like scope around the source."""
    like = nodes.select("id", F.when(F.col("kind").isin("class", "struct", "enum", "trait", "interface"), "class-like").otherwise(F.col("kind")).alias("kind"))
    owner = nearest_ancestor(like, edges, "class-like").where("ancestor is not null")
    fields = edges.where("kind = 'contains'").join(nodes.where("kind = 'field'").select(F.col("id").alias("target"), F.col("name").alias("field")), "target")
    fields = fields.select(F.col("source").alias("ancestor"), "field", F.col("target").alias("node"))
    found = refs.join(owner.select(F.col("id").alias("source"), "ancestor"), "source").join(fields, ["ancestor", "field"]).select("ref", F.lit(0).alias("tier"), "node")
    return refs.select("ref").join(decided(found), "ref", "left").select("ref", "node", F.coalesce("outcome", F.lit("not_found")).alias("outcome"))


# Between repositories


def bridge_exact(providers: DataFrame, consumers: DataFrame) -> DataFrame:
    """(key, consumer member and symbol, provider member and symbol): the only provider of a key, if it is elsewhere."""
    sole = providers.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("member", "symbol")).alias("p")).where("n = 1")
    return consumers.join(sole, "key").where("member <> p.member").select("key", "member", "symbol", F.col("p.member").alias("to_member"), F.col("p.symbol").alias("to_symbol"))


def bridge_fan_out(subscribers: DataFrame, publishers: DataFrame) -> DataFrame:
    """Each publisher with every subscriber of its key in another repository."""
    s = subscribers.select("key", F.col("member").alias("to_member"), F.col("symbol").alias("to_symbol")).dropDuplicates()
    return publishers.dropDuplicates(["key", "member", "symbol"]).join(s, "key").where("member <> to_member")


def consumer_outcomes(providers: DataFrame, consumers: DataFrame) -> DataFrame:
    """Consumers with ``outcome``: bound, ambiguous, no-provider, or null where the only provider is their own repository."""
    n = providers.groupBy("key").agg(F.count("*").alias("n"), F.min("member").alias("provider"))
    return consumers.join(n, "key", "left").select(
        *consumers.columns,
        F.when(F.col("n").isNull(), "no-provider").when(F.col("n") > 1, "ambiguous").when(F.col("provider") != F.col("member"), "bound").alias("outcome"),
    )


def cross_coverage(outcomes: DataFrame) -> DataFrame:
    """(bound, ambiguous, no_provider, bound_bp): what no one provides is not in the denominator; 10000 for nothing."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    d = n("bound") + n("ambiguous")
    bp = F.when(d == 0, 10000).otherwise(F.round(n("bound") / d * 10000)).cast("bigint")
    return outcomes.agg(n("bound").alias("bound"), n("ambiguous").alias("ambiguous"), n("no-provider").alias("no_provider"), bp.alias("bound_bp"))


def topic_inventory(topics: DataFrame, links: DataFrame) -> DataFrame:
    """(topic, producers, consumers); topics without either are kept with zeros. ``links`` has (topic, role, symbol)."""
    by = links.groupBy("topic").agg(F.countDistinct(F.when(F.col("role") == "producer", F.col("symbol"))).alias("p"), F.countDistinct(F.when(F.col("role") == "consumer", F.col("symbol"))).alias("c"))
    return topics.select("topic").distinct().join(by, "topic", "left").select("topic", F.coalesce("p", F.lit(0)).alias("producers"), F.coalesce("c", F.lit(0)).alias("consumers"))


def member_reach(nodes: DataFrame, edges: DataFrame, bridges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What other members' bridges keep alive, in one search for all members.

    nodes (member, id, symbol, is_dead), edges (member, source, target, kind), and bridges
    (from_member, to_member, symbol): a call of another member's symbol. First the verdicts
    (member, id, promoted) of nodes that are dead in their member; then per member the
    tally (member, nodes, seeds, unresolved, promoted, dead), where unresolved counts the
    symbols that bridges name and the member lacks. Ids may repeat between members.
    """
    asked = bridges.where("from_member <> to_member").select(F.col("to_member").alias("member"), "symbol").distinct()
    least = nodes.groupBy("member", "symbol").agg(F.min("id").alias("id"))
    seeds = cut(asked.join(least, ["member", "symbol"], "left"))
    inner = edges.where("kind in ('calls', 'routes_to')").select(F.struct("member", F.col("source").alias("id")).alias("source"), F.struct("member", F.col("target").alias("id")).alias("target"))
    reached = reach(inner, seeds.where("id is not null").select(F.struct("member", "id").alias("id"))).select("id.member", "id.id").withColumn("_r", F.lit(True))
    verdicts = cut(nodes.where("is_dead").select("member", "id").join(reached, ["member", "id"], "left").select("member", "id", F.col("_r").isNotNull().alias("promoted")))
    tally = nodes.groupBy("member").agg(F.count("*").alias("nodes"))
    tally = tally.join(seeds.groupBy("member").agg(F.count("id").alias("seeds"), F.count_if(F.col("id").isNull()).alias("unresolved")), "member", "left")
    tally = tally.join(verdicts.groupBy("member").agg(F.count_if("promoted").alias("promoted"), F.count_if(~F.col("promoted")).alias("dead")), "member", "left")
    return verdicts, tally.fillna(0, ["seeds", "unresolved", "promoted", "dead"])


def portable_key(kind: Column, name: Column) -> Column:
    """struct(protocol, key, role) of a contract node; null for kinds without a contract.

    For brokers the subscriber provides and the publisher consumes.
    """
    http = route_key(name)
    grpc = F.when(name.rlike(r"^[A-Za-z_][\w.]*/[A-Za-z_]\w*$"), name)
    entry = lambda p, k, r: F.when(k.isNotNull(), F.struct(F.lit(p).alias("protocol"), k.alias("key"), F.lit(r).alias("role")))
    return (
        F.when(kind.isin("route", "api_operation"), entry("http", http, "provider"))
        .when(kind == "client_call", entry("http", http, "consumer"))
        .when(kind == "rpc", entry("grpc", grpc, "provider"))
        .when(kind == "rpc_call", entry("grpc", grpc, "consumer"))
        .when(kind == "consumer", entry("broker", F.lower(name), "provider"))
        .when(kind == "producer", entry("broker", F.lower(name), "consumer"))
    )


def implementors(implements: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref, node) of 'implements' references (id, source, target): the only trait of the target's last part."""
    traits = nodes.where("kind = 'trait'").groupBy(F.col("name").alias("k")).agg(F.count("*").alias("n"), F.min("id").alias("node")).where("n = 1")
    last = F.element_at(F.split("target", r"::|\."), -1)
    return implements.select(F.col("id").alias("ref"), last.alias("k")).join(traits, "k").select("ref", "node")


def dynamic_targets(calls: DataFrame, implements: DataFrame, members: DataFrame) -> DataFrame:
    """(ref, node): a call (id, trait, method) on a trait reaches the method of every type that implements it."""
    types = implements.select("trait", "type").distinct()
    return calls.join(types, "trait").join(members.select("type", "method", F.col("id").alias("node")), ["type", "method"]).select(F.col("id").alias("ref"), "node").distinct()


def doc_links(links: DataFrame, files: DataFrame, headings: DataFrame) -> DataFrame:
    """(ref, path, anchor, outcome) of links (id, file_path, target) in documents.

    A path is taken from the document's folder; without one the link stays in the
    document. An anchor must be a heading of the file. outcome is bound, no_file, no_anchor
    or external.
    """
    path = F.regexp_replace("target", r"#.*$", "")
    anchor = F.when(F.contains("target", F.lit("#")), F.regexp_replace("target", r"^[^#]*#", ""))
    folder = F.when(F.contains("file_path", F.lit("/")), F.regexp_replace("file_path", r"/[^/]*$", "/")).otherwise("")
    whole = F.when(path == "", F.col("file_path")).otherwise(folded_path(F.concat(folder, path)))
    rows = links.select(F.col("id").alias("ref"), is_external(F.col("target")).alias("external"), whole.alias("path"), anchor.alias("anchor"))
    rows = rows.join(files.select("path", F.lit(True).alias("_file")), "path", "left").join(headings.select("path", "anchor", F.lit(True).alias("_head")).distinct(), ["path", "anchor"], "left")
    outcome = F.when(F.col("external"), "external").when(F.col("_file").isNull(), "no_file").when(F.col("anchor").isNotNull() & F.col("_head").isNull(), "no_anchor").otherwise("bound")
    return rows.select("ref", "path", "anchor", outcome.alias("outcome"))


def promoted_routes(registrations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(symbol, file_path, name, handler) of route registrations (file_path, method, template, handler).

    One route for each file and key. The handler is the only callable of its name in the
    file; else the only one anywhere; else null.
    """
    key = F.concat_ws(" ", F.upper("method"), F.col("template"))
    first = registrations.withColumn("name", key).groupBy("file_path", "name").agg(F.min("handler").alias("handler_name"))
    calls = nodes.where("kind in ('function', 'method')")
    own = calls.groupBy("file_path", F.col("name").alias("handler_name")).agg(F.count("*").alias("n1"), F.min("id").alias("h1"))
    all_ = calls.groupBy(F.col("name").alias("handler_name")).agg(F.count("*").alias("n2"), F.min("id").alias("h2"))
    both = first.join(own, ["file_path", "handler_name"], "left").join(all_, "handler_name", "left")
    handler = F.when(F.col("n1") == 1, F.col("h1")).when(F.col("n1").isNull() & (F.col("n2") == 1), F.col("h2"))
    return both.select(F.concat(F.lit("route/"), F.col("file_path"), F.lit("#"), F.col("name")).alias("symbol"), "file_path", "name", handler.alias("handler"))


def source_routes(facts: DataFrame) -> DataFrame:
    """promoted_routes() of the registrations that extraction found in source files (rows of FACTS)."""
    part = F.split("name", " ", 2)
    found = facts.where("kind = 'route'").select(F.col("path").alias("file_path"), part[0].alias("method"), part[1].alias("template"), F.col("target").alias("handler"))
    nodes = facts.where("kind in ('function', 'method')").select(F.xxhash64("path", "parent", "name", "line").alias("id"), "kind", "name", F.col("path").alias("file_path"))
    return promoted_routes(found, nodes)


def source_client_calls(facts: DataFrame) -> DataFrame:
    """(file_path, scope, line, target, refusal) of the client sites that extraction found."""
    sites = facts.where("kind = 'client_site'")
    dynamic = F.when(F.col("target").isNull(), F.create_map(F.lit("path_dynamic"), F.lit("true"))).otherwise(F.create_map(F.lit("path"), F.col("target")))
    call = client_call(F.map_concat(F.create_map(F.lit("method"), F.col("name")), dynamic))
    return sites.select(F.col("path").alias("file_path"), F.col("parent").alias("scope"), "line", call.alias("c")).select("file_path", "scope", "line", "c.target", "c.refusal")


def dispatch_roots(facts: DataFrame) -> DataFrame:
    """(file_path, owner, name) of functions that only a trait's table or a framework calls; they are live without a caller."""
    return facts.where("kind = 'dispatch'").select(F.col("path").alias("file_path"), F.col("target").alias("owner"), "name").distinct()


def topic_nodes(facts: DataFrame) -> DataFrame:
    """(symbol, kind, name, file_path, line, topic) of topics and of the places that publish to or subscribe to them.

    A topic is one node however many files name it; a function that publishes to a topic
    more than once is one producer, at its first line. ``topic`` is the symbol that a
    producer's or consumer's edge leads to, null for topics.
    """
    found = facts.where("kind in ('publish', 'subscribe')")
    role = F.when(F.col("kind") == "publish", "producer").otherwise("consumer")
    symbol = F.concat_ws("/", "file_path", "owner", "kind", "name")
    topic = F.concat(F.lit("topic/"), F.col("name"))
    sites = found.groupBy(F.col("path").alias("file_path"), F.col("parent").alias("owner"), role.alias("kind"), "name").agg(F.min("line").alias("line"))
    sites = sites.select(symbol.alias("symbol"), "kind", "name", "file_path", "line", topic.alias("topic"))
    nothing = F.lit(None).cast("string")
    return found.select("name").distinct().select(topic.alias("symbol"), F.lit("topic").alias("kind"), "name", nothing.alias("file_path"), nothing.cast("bigint").alias("line"), nothing.alias("topic")).unionByName(sites)


def marked_live(facts: DataFrame) -> DataFrame:
    """(source, target, kind): a route to itself for each function of a file that only a trait or a framework calls, by symbol."""
    roots = dispatch_roots(facts)
    symbol = F.concat_ws("/", "file_path", "owner", "name")
    return roots.select(symbol.alias("source"), symbol.alias("target"), F.lit("routes_to").alias("kind"))


def in_scope(reached: DataFrame, members: DataFrame, repository: str | None) -> DataFrame:
    """Reached nodes of one repository; of all for None."""
    both = reached.join(members.select("id", "member"), "id")
    return both if repository is None else both.where(F.col("member") == repository)


def service_map(members: DataFrame, bridges: DataFrame, topics: DataFrame) -> DataFrame:
    """(node, kind, links_out, links_in): members and topics, and how many others each is linked to.

    ``topics`` has (topic, member) of what members publish.
    """
    nodes = members.select(F.col("member").alias("node"), F.lit("member").alias("kind")).union(topics.select("topic", F.lit("topic"))).union(topics.select("member", F.lit("member"))).distinct()
    links = bridges.select(F.col("member").alias("source"), F.col("to_member").alias("target")).union(topics.select("member", "topic")).distinct()
    out = links.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("links_out"))
    in_ = links.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("links_in"))
    return nodes.join(out, "node", "left").join(in_, "node", "left").fillna(0, ["links_out", "links_in"])
