"""Merkle manifest of a table of documents, with a proof per row.

A row is a leaf: the hash of its five fields, each behind its length.  The
leaves of a language, in the order of doc_id, are ranked from 0; every `FAN`
consecutive nodes of a level become their hash one level up, until one node is
left, the language's subroot.  The subroots, ordered by language, make one more
tree, whose root names the whole table.

Nodes carry nested-interval labels: the interval [lo, hi) of leaf ranks that
they cover.  A level is computed from the one below by grouping on the parent's
bucket, lo div FAN**level, so no group has more than FAN rows.  Proofs come
from the top down: at each level a containment join within the bucket attaches
its parent to every node, the parent's children that lie before and behind the
node's own interval are its siblings, and what was attached to the parent
follows.  A leaf's path is thus made from shared paths of the nodes above it;
what is shuffled falls by FAN with every level.  All of it is Spark
expressions.

Edge cases: a null field is `-` (which no value gives, those have a length in
front).  Null doc_ids come first and count as the empty text in `damaged`; rows
that share a doc_id are ordered by their leaf, and rows that repeat in full are
interchangeable.  Null is a language of its own, the first.  A lone leaf is its
own subroot, a lone subroot the root, and a row without siblings has the empty
text's hash as its proof.  An empty table has no rows and no root.  Only the
five columns of documents are read, whatever the others are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableflow.llm.common import crc_of_id, materialize
from tableflow.llm.sharding import number_rows

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:string,right:string>>"


def hashed(*texts: Column) -> Column:
    """Lowercase hex sha256 of the texts, concatenated."""
    return F.sha2(F.concat(*texts), 256)


def leaf_of(text: Column | None = None) -> Column:
    """The leaf of a row of documents, with another text if one is given."""
    values = [F.col(c).cast("string") for c in FIELDS]
    if text is not None:
        values[-1] = text
    return hashed(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values])


def damaged() -> Column:
    """The text with A-Z in lower case where 3 divides the id's crc32."""
    return F.when(crc_of_id() % 3 == 0, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))


@dataclass(frozen=True)
class Manifest:
    """leaves: tree, n, lo, hi, digest and what the rows carry; levels[k]: the
    nodes k levels above them; subroots: tree, lang, subroot and the path from
    it to the root."""

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    root: str | None

    def nodes(self) -> DataFrame:
        """lang, level, lo, hi, digest of every node of the languages' trees."""
        parts = [df.select("tree", F.lit(k).alias("level"), "lo", "hi", "digest") for k, df in enumerate([self.leaves, *self.levels])]
        every = parts[0]
        for part in parts[1:]:
            every = every.union(part)
        return every.join(self.subroots.select("tree", "lang"), "tree").drop("tree")


def _bucket(level: int) -> Column:
    return F.floor(F.col("lo") / F.lit(FAN**level)).cast("bigint")


def _grow(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The levels above the leaves: tree, n, lo, hi, kids, digest.  A tree of n
    leaves has one node from the first level on whose FAN**level reaches n."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, below = [], leaves
    while FAN ** len(levels) < most:
        k = len(levels)
        kids = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("kids")
        up = below.where(F.col("n") > FAN**k).groupBy("tree", "n", _bucket(k + 1).alias("bucket")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), kids)
        up = up.select("tree", "n", "lo", "hi", "kids", F.sha2(F.array_join("kids.digest", ""), 256).alias("digest"))
        below = materialize(up, f"{name}-{k + 1}")
        levels.append(below)
    return levels


def _roots(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """tree, digest of every tree's only node at its top."""
    found = None
    for k, df in enumerate([leaves, *levels]):
        top = df.where((F.col("n") <= FAN**k) & (F.lit(k == 0) | (F.col("n") > FAN ** max(0, k - 1)))).select("tree", "digest")
        found = top if found is None else found.union(top)
    return found


def _paths(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves, each with its siblings (left and right of it, level by
    level) and then its tree's path in `tops` (tree, subroot, path)."""
    above = None
    every = [leaves, *levels]
    for k in reversed(range(len(every))):
        nodes = every[k]
        kept = [nodes[c] for c in nodes.columns]
        here = nodes.where(F.col("n") <= FAN**k).join(tops, "tree").select(*kept, "subroot", "path")
        if above is not None:
            parent = above.select(
                F.col("tree").alias("p_tree"),
                _bucket(k + 1).alias("p_bucket"),
                F.col("lo").alias("p_lo"),
                F.col("hi").alias("p_hi"),
                "kids",
                "subroot",
                "path",
            ).withColumnRenamed("kids", "p_kids")
            child = nodes.where(F.col("n") > FAN**k)
            inside = (F.col("p_tree") == F.col("tree")) & (F.col("p_bucket") == _bucket(k + 1)) & (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi"))
            joined = child.join(parent, inside)
            before = F.array_join(F.transform(F.filter("p_kids", lambda x: x["hi"] <= F.col("lo")), lambda x: x["digest"]), "")
            behind = F.array_join(F.transform(F.filter("p_kids", lambda x: x["lo"] >= F.col("hi")), lambda x: x["digest"]), "")
            step = F.array(F.struct(before.alias("left"), behind.alias("right")))
            here = here.union(joined.select(*[F.col(c) for c in nodes.columns], "subroot", F.concat(step, "path").alias("path")))
        above = here
    return above


def build(rows: DataFrame) -> Manifest:
    """The manifest of rows: lang, doc_id, digest (the leaf) and what else a
    leaf shall carry."""
    spark = rows.sparkSession
    # Equal rows are dealt over tasks by where they come from.
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("__from")]
    numbered = number_rows(rows.withColumn("__from", F.monotonically_increasing_id()), *order).drop("__from")
    # The first row of a language names its tree; first rows ascend as the languages do.
    trees = materialize(numbered.groupBy("lang").agg(F.min("row_number").alias("tree"), F.count("*").alias("n")), "merkle-trees")
    named = numbered.join(trees.withColumnRenamed("lang", "tree_lang"), F.col("lang").eqNullSafe(F.col("tree_lang")))
    rank = F.col("row_number") - F.col("tree")
    leaves = materialize(named.withColumns({"lo": rank, "hi": rank + 1}).drop("tree_lang", "row_number", "lang"), "merkle-leaves")
    levels = _grow(leaves, "merkle-level")
    tops = materialize(number_rows(_roots(leaves, levels), "tree"), "merkle-subroots")
    n = tops.count()
    heads = tops.select(F.lit(0).cast("bigint").alias("tree"), F.lit(n).cast("bigint").alias("n"), F.col("row_number").alias("lo"), (F.col("row_number") + 1).alias("hi"), "digest", F.col("tree").alias("of"))
    crown = _grow(heads, "merkle-crown")
    last = _roots(heads, crown).first()
    nothing = spark.range(1).select(F.lit(0).cast("bigint").alias("tree"), F.lit(None).cast("string").alias("subroot"), F.array().cast(_PATH).alias("path"))
    subroots = _paths(heads, crown, nothing).select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), "path")
    subroots = materialize(subroots.join(trees.select("tree", "lang"), "tree"), "merkle-paths")
    return Manifest(leaves, levels, subroots, last["digest"] if last else None)


def prove(manifest: Manifest) -> DataFrame:
    """The leaves with subroot and path: for each level up to the root the
    siblings left and right of the node that covers the leaf."""
    return _paths(manifest.leaves, manifest.levels, manifest.subroots.select("tree", "subroot", "path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def verify_documents(docs: DataFrame, claimed: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 of docs, and what the proofs
    make of the rows with `claimed` for their text: folded_root, verified."""
    other = leaf_of(claimed)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        leaf_of().alias("digest"),
        F.when(claimed.eqNullSafe(F.col("text")), F.lit(None)).otherwise(other).alias("other"),
    )
    manifest = build(rows)
    proven = prove(manifest)
    every = F.array_join(F.transform("path", lambda step: F.concat(step["left"], step["right"])), "")
    folded = fold(F.coalesce("other", "digest"), F.col("path"))
    root = F.lit(manifest.root).cast("string")
    out = proven.select("doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), F.sha2(every, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
