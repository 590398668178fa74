"""The corpus pipeline: five stages over ``documents``, each written and read again by the next.

language  documents in no learned language (no letters, or less than even odds) go
lines     aligned common lines go from the later of two overlapping documents; a
          document that loses all of its lines goes
near      of each group of near copies the document with the smallest key stays
mix       whole documents by the leaf budgets of a tree of domain, language and source;
          each document once at most
pieces    the ids of every text

Columns a stage doesn't know, whatever their names, come through all but the last as they
are: rows travel as one struct. Rows that repeat a key are one document and stay or go
together, but for a mix that ends between two of them. A null or empty text has no letter
and goes in the first stage, and a row with a null key is a document of its own. Of equal
texts the one with the smallest key stays. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import boxed, materialize, quoted, read_table, unboxed
from codeloom.llm.jaccard_join import similar_groups
from codeloom.llm.line_align import boxed_lines
from codeloom.llm.mixing import MixConfig, counted, domain_of, leaf_plan, select_mix
from codeloom.llm.piece_tokenizer import encode_pieces, load_model
from codeloom.llm.ppm_language import language_of, learn
from codeloom.llm.queries import PIECES

LEAST_LANGUAGE_SCORE = 0.5
CACHED_UNITS = 150_000  # the executors' memory is shared with what earlier stages left
MIX = MixConfig(percent=80, max_epochs=1)


def _out(rows: DataFrame, box: Column) -> DataFrame:
    """The rows of a struct, as a table again."""
    found = rows.select(box.alias("box"))
    return found.select(*unboxed(found, "box"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a learned language go; a null ``lang`` becomes the predicted one."""
    model = learn(docs, "doc_id", "text", "lang")
    scored = docs.select(boxed(docs).alias("box"), language_of(spark, F.col("text"), model).alias("found"))
    kept = scored.where((F.col("found.lang_pred") != "und") & (F.col("found.score") >= LEAST_LANGUAGE_SCORE))
    return _out(kept, F.col("box").withField("lang", F.coalesce("box.lang", "found.lang_pred")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``text`` without its common lines, and ``n_chars`` to match. A document that had none stays as it was, empty or not."""
    found = boxed_lines(docs)
    some = found.where((F.col("n_removed") == 0) | (F.length(F.trim("kept_text")) > 0))
    box = F.col("box").withField("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        box = box.withField("n_chars", F.length("kept_text").cast("bigint"))
    return _out(some, box)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group, as it is. Documents without words are no one's copies."""
    other = similar_groups(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(other.hint("shuffle_hash"), "doc_id", "left_anti").select(*[quoted(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the budgets of their leaves select, whole and once. Those without words are never selected."""
    rows = docs.select(boxed(docs).alias("box"), domain_of(F.col("source")).alias("domain"), "lang", "source", "doc_id", "text")
    tokens = materialize(counted(rows, "doc_id", "text", MIX).drop("box"), "mix-tokens")
    plan = materialize(leaf_plan(tokens, MIX), "mix-plan")
    return _out(select_mix(counted(rows, "doc_id", "text", MIX, F.col("box")), plan, MIX), F.col("box"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang and the ids of the whole text; none for a null or empty one."""
    rows = encode_pieces(docs.select("doc_id", "source", "lang", "text"), load_model(PIECES), cached_units=CACHED_UNITS)
    return rows.select("doc_id", "source", "lang", F.size("ids").cast("bigint").alias("n_ids"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near", near),
    ("mix", mix),
    ("pieces", pieces),
]
# Language models, patience alignment and piece encoding can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
