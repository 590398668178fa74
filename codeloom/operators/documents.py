"""Stored pages with anchors, their freshness, and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.scalars import basis_points, folded_path, short_title

MOST_BYTES = 1 << 20


def valid_page(slug: Column, body: Column) -> Column:
    return slug.rlike(r"^[a-z0-9]+([/-][a-z0-9]+)*$") & (F.length(F.trim(body)) > 0) & (F.octet_length(body) <= MOST_BYTES)


def upserted(pages: DataFrame, drafts: DataFrame, key: str = "slug") -> DataFrame:
    """The pages, with drafts in place of those of the same key."""
    return pages.join(drafts.select(key), key, "left_anti").unionByName(drafts)


def anchor_states(anchors: DataFrame, current: DataFrame) -> DataFrame:
    """Anchors with ``state``: missing, fresh or stale, by the entity's current hash."""
    now = current.select("entity_id", F.col("content_hash").alias("now"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("content_hash"), "fresh").otherwise("stale")
    return anchors.join(now, "entity_id", "left").withColumn("state", state).drop("now")


def page_states(states: DataFrame) -> DataFrame:
    """(slug, anchors, fresh, state): fresh if all anchors are; missing if one is; else stale."""
    n = lambda s: F.count_if(F.col("state") == s)
    return states.groupBy("slug").agg(F.count("*").alias("anchors"), n("fresh").alias("fresh"), F.when(n("missing") > 0, "missing").when(n("stale") > 0, "stale").otherwise("fresh").alias("state"))


def page_summary(by_page: DataFrame) -> DataFrame:
    """(pages, fresh_pages, fresh_bp); null without pages."""
    n = F.count("*")
    fresh = F.count_if(F.col("state") == "fresh")
    return by_page.agg(n.alias("pages"), fresh.alias("fresh_pages"), F.when(n > 0, basis_points(fresh / n)).alias("fresh_bp"))


def unanchored(candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """Candidates (kind, entity_id) that no page is anchored to."""
    return candidates.join(anchors.select("kind", "entity_id"), ["kind", "entity_id"], "left_anti")


def pruned(pages: DataFrame, valid: DataFrame, key: str = "slug") -> tuple[DataFrame, DataFrame]:
    """Pages that stay, and those that go since their key is not among the valid ones."""
    return pages.join(valid.select(key), key, "left_semi"), pages.join(valid.select(key), key, "left_anti")


def folder_counts(files: DataFrame, counts: DataFrame) -> DataFrame:
    """(prefix, depth, files, nodes): for every folder and file, what lies below it. Files without nodes count 0."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("prefix"), i.alias("depth")))
    rows = files.select("path").join(counts.select("path", "n"), "path", "left").select(F.explode(prefixes).alias("p"), F.coalesce("n", F.lit(0)).alias("n"))
    return rows.groupBy("p.prefix", "p.depth").agg(F.count("*").alias("files"), F.sum("n").alias("nodes"))


def materialized(pages: DataFrame, group: str, order: str, body: str) -> DataFrame:
    """(group, document): bodies of a group's pages in order. A group is one output document, as its author made it."""
    return pages.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, body))).alias("p")).select(group, F.array_join(F.transform("p", lambda x: x[body]), "\n\n").alias("document"))


LINK = r"\]\(([^()\s]+)\)"


def with_links(docs: DataFrame, targets: DataFrame, key: str = "id", path: str = "path", body: str = "body") -> DataFrame:
    """docs with the links in ``body`` rewritten: those that lead to a path of ``targets`` (path, href) get its href.

    A link's path counts from the document's own folder, or from the root if it begins with
    a separator; what follows a '#' is kept. Links to other places, with a scheme, or out of
    the root stay as they are. Links are taken out by their position, looked up by path, all
    of one path as one, and put back in order.
    """
    found = F.regexp_extract_all(F.col(body), F.lit(LINK), F.lit(1))
    each = docs.where(F.col(body).isNotNull()).select(F.col(key).alias("key"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("folder"), F.posexplode(found).alias("at", "link"))
    place, fragment = F.regexp_extract("link", r"^([^#]*)", 1), F.regexp_extract("link", r"(#.*)$", 1)
    full = folded_path(F.when(F.startswith("link", F.lit("/")), place).otherwise(F.concat_ws("/", F.nullif("folder", F.lit("")), place)))
    local = ~F.col("link").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^#")
    each = each.select("key", "at", "link", fragment.alias("fragment"), F.when(local, full).alias("to"))
    known = targets.groupBy(F.col("path").alias("to")).agg(F.min("href").alias("href"))
    new = each.join(known, "to", "left").select("key", "at", F.coalesce(F.concat("href", "fragment"), "link").alias("link"))
    links = new.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "link"))).alias("links"))  # of one document
    pieces = F.split(F.col(body), r"\]\([^()\s]+\)", -1)
    back = F.array_join(F.zip_with(pieces, F.col("links.link"), lambda p, x: F.concat(p, F.coalesce(F.concat(F.lit("]("), x, F.lit(")")), F.lit("")))), "")
    both = docs.join(links.withColumnRenamed("key", key), key, "left")
    return both.select(*[F.when(F.col("links").isNotNull(), back).otherwise(F.col(body)).alias(body) if c == body else F.col(c) for c in docs.columns])


def generation_queue(missing: DataFrame, stale: DataFrame) -> DataFrame:
    """What to write next: missing pages first, then stale ones, by slug."""
    both = missing.select("slug", F.lit(0).alias("category")).union(stale.select("slug", F.lit(1)))
    return both.orderBy("category", "slug")


def threads(messages: DataFrame) -> DataFrame:
    """(conv_id, title, messages, next_turn) by first user message."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("conv_id").agg(short_title(first).alias("title"), F.count("*").alias("messages"), (F.coalesce(F.max("turn") + 1, F.lit(0))).alias("next_turn"))


def transcript(messages: DataFrame, conv_id: int) -> DataFrame:
    return messages.where(F.col("conv_id") == conv_id).orderBy("turn").select("turn", "role", "text")
