"""Corpus pipeline: toxicity, near duplicates, repeated sentences, benchmark
leaks, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs; each
but the last returns the columns of documents.  A stage reads only doc_id and
text of docs and hands the other columns through in a box, whatever their
names; where it changes a text, n_chars follows.  Null texts and empty tables pass through
every stage; how rows that repeat or share a doc_id are treated is said in the
operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableflow.llm import decontaminate, jaccard, lines, packing, toxicity
from tableflow.llm.common import ROW, keyed, materialize, table, tokenizer_file
from tableflow.operators.names import quote

_DOC = "__llm_document"

#: Near duplicates: documents whose word 5-grams have a Jaccard similarity of
#: 80 % or more.  (op8's query has values of its own.)
NEAR_WORDS, NEAR_PERCENT = 5, 80


def _boxed(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns, text, and all columns but text as one that no
    operator looks into."""
    return docs.select(*columns, "text", F.struct(*[F.col(quote(c)) for c in docs.columns if c != "text"]).alias(_DOC))


def _unboxed(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs, the named ones changed."""
    own = {c: F.col("text") if c == "text" else F.col(_DOC).getField(c) for c in docs.columns}
    return rows.select(*[changed.get(c, own[c]).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxicity.in_training_part())
    return _unboxed(toxicity.score(_boxed(docs), model).where(F.col("score") < toxicity.THRESHOLD), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the first stays."""
    rows = keyed(_boxed(docs, "doc_id"), "text", _DOC)
    heads = jaccard.jaccard_components(rows.select(ROW, "text"), NEAR_WORDS, NEAR_PERCENT).where(F.col(ROW) == F.col("component")).select(ROW)
    return _unboxed(rows.join(heads, ROW, "left_semi"), docs)


def drop_repeated_sentences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each repeated sentence, line, paragraph or long passage the first
    occurrence stays in its document."""
    rows = keyed(_boxed(docs, "doc_id"), "text", _DOC)
    joined = rows.join(lines.repeats(rows.select(ROW, "text"), "all", lines.LONG_WORDS, lines.LONG_BYTES, lines.PASSAGE_WORDS), ROW, "left")
    whole, rest = F.col("spans").isNull(), lines.remove_spans(F.col("text"), F.col("spans"))
    changed = {"text": F.when(whole, F.col("text")).otherwise(rest)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(whole, F.col(_DOC)["n_chars"]).otherwise(F.char_length(rest))
    return _unboxed(joined, docs, **changed)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    found = decontaminate.find_leaks(_boxed(docs), table(spark, sf_dir, "benchmark"))
    return _unboxed(found.where(F.size("hit") == 0), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence of at most 1024 tokens."""
    return packing.pack(docs, tokenizer_file(), with_ids=False).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeated_sentences),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: The first stage is a trained model: no SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
