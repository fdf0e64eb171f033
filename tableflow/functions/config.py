"""Flatten configuration documents (JSON text) into placeholder rows.

Rules: every top-level string value ``k: v`` gives ``{k} -> v``; under the
top-level object ``jobs`` only, every string value ``job: {k: v}`` gives
``{job.k} -> v``.  Numbers, booleans, nulls, lists and other objects are
ignored.  Order is document order (the jobs stand where ``jobs`` does); a
placeholder produced twice keeps its first position and its last value.

Each document is parsed and flattened inside its own row with higher-order
functions: no shuffle and no Python, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ENTRY = "struct<placeholder: string, value: string>"


def _string_entries(json_text: Column, make_placeholder) -> Column:
    """``[{placeholder, value}]`` for the string members of a JSON object
    (document order); null when the text is not an object."""
    members = F.map_entries(F.from_json(json_text, "map<string,variant>"))
    strings = F.filter(members, lambda e: F.schema_of_variant(e["value"]) == F.lit("STRING"))
    return F.transform(
        strings,
        lambda e: F.struct(
            make_placeholder(e["key"]).alias("placeholder"),
            F.variant_get(e["value"], "$", "string").alias("value"),
        ),
    )


def _entries(doc: Column) -> Column:
    """Ordered ``[{placeholder, value}]`` of one document, repeats kept.

    The top level is parsed once and walked in document order: a string
    member gives its entry, and an object ``jobs`` gives its jobs' entries in
    its place.  A variant object sorts its keys, so the order inside ``jobs``
    comes from the member's raw text; what is an object there is looked up by
    key in the parsed value (a string that looks like JSON is none).
    """
    empty = F.array().cast(f"array<{_ENTRY}>")
    jobs_text = F.get_json_object(doc, "$.jobs")

    def of_jobs(jobs: Column) -> Column:
        types = F.try_variant_get(jobs, "$", "map<string,variant>")
        per_job = F.transform(
            F.map_entries(F.from_json(jobs_text, "map<string,string>")),
            lambda j: F.when(
                F.schema_of_variant(F.try_element_at(types, j["key"])).startswith("OBJECT"),
                _string_entries(
                    j["value"], lambda k: F.concat(F.lit("{"), j["key"], F.lit("."), k, F.lit("}"))
                ),
            ),
        )
        return F.flatten(F.filter(per_job, lambda a: a.isNotNull()))

    def of_member(e: Column) -> Column:
        kind = F.schema_of_variant(e["value"])
        own = F.struct(
            F.concat(F.lit("{"), e["key"], F.lit("}")).alias("placeholder"),
            F.try_variant_get(e["value"], "$", "string").alias("value"),
        )
        jobs = (e["key"] == F.lit("jobs")) & kind.startswith("OBJECT")
        return F.when(kind == F.lit("STRING"), F.array(own)).when(jobs, of_jobs(e["value"])).otherwise(empty)

    members = F.map_entries(F.from_json(doc, "map<string,variant>", {"mode": "FAILFAST"}))
    return F.coalesce(F.flatten(F.transform(members, of_member)), empty)


def _first_position_last_value(entries: Column) -> Column:
    """A repeated placeholder keeps its first position and its last value:
    sorted by (placeholder, position), a run's first row has the position and
    its last row the value."""
    numbered = F.transform(
        entries,
        lambda e, i: F.struct(e["placeholder"].alias("placeholder"), i.alias("at"), e["value"].alias("value")),
    )

    def of_sorted(s: Column) -> Column:
        name = lambda k: F.get(s, k)["placeholder"]
        heads = F.filter(s, lambda x, k: ~x["placeholder"].eqNullSafe(name(k - 1)))
        tails = F.filter(s, lambda x, k: ~x["placeholder"].eqNullSafe(name(k + 1)))
        placed = F.zip_with(
            heads,
            tails,
            lambda h, t: F.struct(h["at"].alias("at"), h["placeholder"].alias("placeholder"), t["value"].alias("value")),
        )
        return F.transform(
            F.array_sort(placed),
            lambda e: F.struct(e["placeholder"].alias("placeholder"), e["value"].alias("value")),
        )

    return F.transform(F.array(F.array_sort(numbered)), of_sorted)[0]


def malformed_documents(df: DataFrame, doc_column: str) -> DataFrame:
    """Rows whose document is not valid JSON.  ``flatten_placeholders``
    raises at one; a large input can be reported and filtered first."""
    doc = F.col(f"`{doc_column}`")
    return df.filter(doc.isNotNull() & F.try_parse_json(doc).isNull())


def placeholder_entries(doc: str | Column) -> Column:
    """The ordered, de-duplicated ``array<struct<placeholder, value>>`` of
    one document, as a single expression.  ``flatten_placeholders`` stages
    the same work over projections so each step runs once per document."""
    d = F.col(doc) if isinstance(doc, str) else doc
    entries = _entries(d)
    names = F.transform(entries, lambda e: e["placeholder"])
    unique = F.size(F.array_distinct(names)) == F.size(names)
    return F.when(unique, entries).otherwise(_first_position_last_value(entries))


def flatten_placeholders(
    df: DataFrame, doc_column: str, keep: Sequence[str] = (), ordinal: str = "ordinal"
) -> DataFrame:
    """One row per placeholder: ``keep`` columns, ``ordinal`` (0-based
    position in the document's mapping), ``placeholder``, ``value``.

    Staged as projections: the document is parsed once into its entry
    array, the repeat check reads that array, and only documents that
    repeat a placeholder pay for the de-duplication.  (Catalyst
    keeps an expensive expression that is used more than once in its own
    projection instead of inlining it.)
    """
    kept = [F.col(f"`{c}`") for c in keep]
    staged = df.select(*kept, _entries(F.col(f"`{doc_column}`")).alias("__entries"))
    staged = staged.select(
        *kept,
        "__entries",
        (
            F.size(F.array_distinct(F.transform("__entries", lambda e: e["placeholder"])))
            == F.size("__entries")
        ).alias("__unique"),
    )
    entries = F.when(F.col("__unique"), F.col("__entries")).otherwise(
        _first_position_last_value(F.col("__entries"))
    )
    exploded = staged.select(*kept, F.posexplode(entries).alias(ordinal, "__entry"))
    return exploded.select(*kept, ordinal, "__entry.placeholder", "__entry.value")
