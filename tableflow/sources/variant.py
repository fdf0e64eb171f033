"""JSON of unknown or drifting shape, parsed once.

Inference by ``read_json`` parses the input twice and makes a column a string as
soon as two records disagree; a declared schema loses what does not fit.  Here
each record is parsed once into a VARIANT, which is kept as Parquet; schema and
columns then come from its binary form, and whatever a column's type cannot hold
stays beside the row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.session import scratch_path
from tableflow.sources.schema import SchemaLike, to_struct

#: Columns that ``fitted`` looks up in a map of all fields; more go by path.
FEW = 64
#: In no text that reads as an integer.
_NO_INTEGER = r"[^0-9+.\-\s\p{Cntrl}]"


def parse_json_once(
    spark: SparkSession,
    paths: str | Sequence[str],
    recursive: bool = True,
    multi_line: bool = False,
    staged: bool = True,
    column: str = "record",
) -> DataFrame:
    """The records as one VARIANT column.  ``staged`` keeps them as Parquet in
    the shared scratch folder, so that later passes parse no text; turn it off
    where one pass follows.  A malformed record raises."""
    reader = spark.read.option("recursiveFileLookup", recursive).option("multiLine", multi_line).option("mode", "FAILFAST")
    raw = reader.option("singleVariantColumn", column).json([paths] if isinstance(paths, str) else list(paths))
    if not staged:
        return raw
    folder = scratch_path(spark, "json-records")
    raw.write.parquet(folder)
    return spark.read.schema(raw.schema).parquet(folder)


def inferred_schema(records: DataFrame, column: str = "record") -> T.StructType:
    """The fields of all records and their widest types, sorted by name: one
    aggregation, combined map-side.  Numbers widen (integers and fractions to
    double); fields that hold different kinds of values become strings, as do
    fields that are null throughout."""
    text = records.agg(F.schema_of_variant_agg(column)).first()[0]
    if not text or not text.startswith("OBJECT<"):
        return T.StructType()
    return _plain(T._parse_datatype_string(re.sub(r"\bOBJECT<", "STRUCT<", text)))


def _plain(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _plain(f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_plain(kind.elementType))
    if isinstance(kind, (T.DecimalType, T.FloatType)):
        return T.DoubleType()
    return T.StringType() if isinstance(kind, (T.VariantType, T.NullType)) else kind


def _field(record: Column, name: str, kind: str) -> Column:
    quote = next((q for q in "'\"" if name and q not in name), None)
    if quote:
        return F.try_variant_get(record, f"$[{quote}{name}{quote}]", kind)
    # A name that no path can quote.
    return F.try_variant_get(F.try_variant_get(record, "$", "map<string,variant>")[name], "$", kind)


def _kind(dtype: T.DataType) -> str:
    return "string" if isinstance(dtype, T.StringType) else dtype.simpleString()


def _typed(raw: Column, dtype: T.DataType, value: Column) -> Column:
    """``value``, a field as its type; as a string scalars as they read, objects
    and arrays as JSON."""
    if not isinstance(dtype, T.StringType):
        return value
    return F.coalesce(value, F.when(~F.is_variant_null(raw), F.to_json(raw)))


def fitted(records: DataFrame, schema: SchemaLike | None = None, rest: str | None = "rest", column: str = "record") -> DataFrame:
    """The records as columns of ``schema`` (inferred if none is given).

    A value that its column's type cannot hold gives null there, and its JSON in
    ``rest``, a map from field name to JSON text that also has the fields that
    the schema does not name.  An object or array that does not read back as it
    was (a part that does not fit, a field that the type does not have, a number
    in another form) is there in full, beside what its column could take.  Rows
    that fit have an empty map; a record that is no object has nulls and its
    JSON under the empty name.  ``rest=None`` leaves the map out."""
    struct = inferred_schema(records, column) if schema is None else to_struct(schema)
    if rest is None:
        return records.select(*[_typed(_field(F.col(column), f.name, "variant"), f.dataType, _field(F.col(column), f.name, _kind(f.dataType))).alias(f.name) for f in struct.fields])
    # Fields and values are worked out once, each step looking at the one before.
    # Every path into a record searches it anew, so a few columns come from the
    # map of all fields, which the rest needs anyway; many would search the map.
    fields = F.try_variant_get(column, "$", "map<string,variant>")
    once, raws, typed = records.select(F.col(column).alias("record"), fields.alias("fields")), [], []
    for f in struct.fields:
        raws.append(F.col("fields")[f.name] if len(struct.fields) <= FEW else _field(F.col("record"), f.name, "variant"))
        value = F.try_variant_get(raws[-1], "$", _kind(f.dataType))
        if isinstance(f.dataType, T.IntegralType):
            # A cast that fails costs more than all else of the row.
            text = (F.schema_of_variant(raws[-1]) == "STRING") & F.try_variant_get(raws[-1], "$", "string").rlike(_NO_INTEGER)
            value = F.when(~F.coalesce(text, F.lit(False)), value)
        typed.append(_typed(raws[-1], f.dataType, value))
    once = once.select("record", "fields", *[v.alias(f"c{i}") for i, v in enumerate(typed)])
    misfits = []
    for i, f in enumerate(struct.fields):
        if isinstance(f.dataType, T.StringType):
            continue
        raw, value = raws[i], F.col(f"c{i}")
        lost = value.isNull()
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            # Parts may be lost where the whole is not.
            back = [F.to_json(value, {"ignoreNullFields": flag}) for flag in ("true", "false")]
            lost = lost | ~F.to_json(raw).isin(*back)
        misfits.append(F.when(F.coalesce(lost, F.lit(True)) & raw.isNotNull() & ~F.is_variant_null(raw), F.lit(f.name)))
    names = F.array_compact(F.array(*misfits)).cast("array<string>") if misfits else F.array().cast("array<string>")
    if struct.names:
        foreign = F.array_except(F.map_keys("fields"), F.array(*[F.lit(n) for n in struct.names]))
    else:
        foreign = F.map_keys("fields")
    once = once.select("*", F.concat(foreign, names).alias("names"))
    # Most rows have nothing to keep and take the first branch.
    beside = F.map_filter("fields", lambda k, v: F.array_contains("names", k))
    beside = F.when(F.size("names") == 0, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).otherwise(F.transform_values(beside, lambda k, v: F.to_json(v)))
    whole = F.create_map(F.lit(""), F.to_json("record"))
    named = [F.col(f"c{i}").alias(f.name) for i, f in enumerate(struct.fields)]
    return once.select(*named, F.when(F.col("fields").isNotNull(), beside).otherwise(whole).alias(rest))


def read_json_fitted(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: SchemaLike | None = None,
    rest: str | None = "rest",
    recursive: bool = True,
    multi_line: bool = False,
) -> DataFrame:
    """``parse_json_once`` and ``fitted``: one parse of the text.  With a
    declared schema there is one pass and nothing is staged."""
    records = parse_json_once(spark, paths, recursive, multi_line, staged=schema is None)
    return fitted(records, schema, rest)
