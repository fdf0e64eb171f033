"""In-place upsert that rewrites only the files that hold a changed key.

The table is a folder of immutable Parquet files and of manifests; the newest
manifest names the files that count.  A merge finds the files that hold a
source key (``_metadata.file_path`` behind a semi join of key columns only),
rewrites the rows of these, and publishes a manifest that names the untouched
files and the new ones.  A run that dies before that leaves the old table as it
was; of two runs at a time the second to publish is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.operators.names import quote
from tableflow.operators.quality import keep_last
from tableflow.sinks import files

_DIGITS = 20
#: Types whose bounds are pushed into the scan that looks for touched files.
_BOUNDED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.DateType)


class ConcurrentMerge(RuntimeError):
    """Another run published a version first; nothing was changed."""


@dataclass(frozen=True)
class MergeResult:
    """The version published, and the table's files by what became of them."""

    version: int
    kept: list[str]
    rewritten: list[str]
    added: list[str]


@dataclass(frozen=True)
class FileTable:
    spark: SparkSession
    path: str

    def version(self) -> int:
        """The newest version; 0 before the first."""
        found = [n for n in files.names(self.spark, f"{self.path}/versions") if n.isdigit()]
        return int(max(found, default="0"))

    def _manifest(self, version: int) -> dict:
        return json.loads(files.read_text(self.spark, f"{self.path}/versions/{version:0{_DIGITS}d}"))

    def files(self, version: int | None = None) -> list[str]:
        """Names (below ``data``) of a version's files."""
        return self._manifest(version or self.version())["files"]

    def read(self, version: int | None = None) -> DataFrame:
        manifest = self._manifest(version or self.version())
        return self._rows(manifest["files"], T.StructType.fromJson(manifest["schema"]))

    def _rows(self, names: Sequence[str], schema: T.StructType) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{n}" for n in names])

    def _write(self, rows: DataFrame) -> list[str]:
        batch = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{batch}")
        return [f"{batch}/{n}" for n in files.names(self.spark, f"{self.path}/data/{batch}") if n.startswith("part-")]

    def _publish(self, version: int, names: Sequence[str], schema: T.StructType) -> None:
        text = json.dumps({"schema": schema.jsonValue(), "files": list(names)})
        if not files.write_text_new(self.spark, f"{self.path}/versions/{version:0{_DIGITS}d}", text):
            raise ConcurrentMerge(f"version {version} of {self.path} was published by another run")

    def replace(self, rows: DataFrame) -> MergeResult:
        """A version that holds ``rows`` alone, one file per partition."""
        version = self.version()
        old = self.files(version) if version else []
        new = self._write(rows)
        self._publish(version + 1, new, rows.schema)
        return MergeResult(version + 1, [], old, new)

    def touched(self, source: DataFrame, keys: Sequence[str], version: int | None = None) -> list[str]:
        """The files with a row whose key the source has.  Only key columns are
        read; what comes to the driver is file names."""
        target = self.read(version)
        kinds = {f.name: f.dataType for f in target.schema.fields}
        bounded = [k for k in keys if isinstance(kinds[k], _BOUNDED)]
        if bounded:  # lets the scan pass over row groups that cannot match
            row = source.agg(*[f(quote(k)) for k in bounded for f in (F.min, F.max)]).first()
            for i, k in enumerate(bounded):
                if row[2 * i] is None:
                    return []
                target = target.where(F.col(quote(k)).between(F.lit(row[2 * i]), F.lit(row[2 * i + 1])))
        name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+/[^/]+)$", 1)
        have = target.select(*[F.col(quote(k)).alias(f"__k{i}") for i, k in enumerate(keys)], name.alias("__file"))
        want = source.select(*[F.col(quote(k)).alias(f"__s{i}") for i, k in enumerate(keys)])
        same = [F.col(f"__k{i}") == F.col(f"__s{i}") for i in range(len(keys))]
        return sorted(r[0] for r in have.join(want, same, "left_semi").select("__file").distinct().collect())

    def merge(
        self,
        source: DataFrame,
        keys: str | Sequence[str],
        order_by: str | Sequence[str] | None = None,
        overwrite: bool = True,
    ) -> MergeResult:
        """Upsert ``source`` by ``keys`` (``overwrite=False``: rows of known
        keys stay as they are, new ones are added).  The result is that of
        ``reconcile.upsert`` / ``insert_missing``; null keys never match.

        The source needs the table's columns and is evaluated two or three
        times (bounds, touched files, rows); persist it if that is dear."""
        keys = [keys] if isinstance(keys, str) else list(keys)
        version = self.version()
        manifest = self._manifest(version)
        schema = T.StructType.fromJson(manifest["schema"])
        if order_by is not None:
            source = keep_last(source, keys, order_by)
        source = source.select(*[F.col(quote(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields])
        if overwrite:
            hit = self.touched(source, keys, version)
            rows = source
            if hit:
                rows = source.unionByName(_without(self._rows(hit, schema), source, keys))
        else:
            hit = []
            rows = _without(source, self._rows(manifest["files"], schema), keys)
        # AQE makes the new files about as large as its advisory size.
        new = self._write(rows.hint("rebalance"))
        gone = set(hit)
        kept = [f for f in manifest["files"] if f not in gone]
        self._publish(version + 1, [*kept, *new], schema)
        return MergeResult(version + 1, kept, hit, new)

    def vacuum(self, keep: int = 1) -> int:
        """Delete the files that none of the last ``keep`` versions names (of
        older versions, and of runs that died), and older manifests; how many
        data files went.  Not while a merge runs."""
        newest = self.version()
        wanted = {f for v in range(max(1, newest - keep + 1), newest + 1) for f in self.files(v)}
        gone = 0
        for batch in files.names(self.spark, f"{self.path}/data"):
            own = [f"{batch}/{n}" for n in files.names(self.spark, f"{self.path}/data/{batch}") if n.startswith("part-")]
            spare = [f for f in own if f not in wanted]
            gone += len(spare)
            for f in [batch] if len(spare) == len(own) else spare:
                files.delete(self.spark, f"{self.path}/data/{f}")
        for v in range(1, newest - keep + 1):
            files.delete(self.spark, f"{self.path}/versions/{v:0{_DIGITS}d}")
        return gone


def _without(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key ``other`` does not have."""
    want = other.select(*[F.col(quote(k)).alias(f"__o{i}") for i, k in enumerate(keys)])
    same = [F.col(quote(k)) == F.col(f"__o{i}") for i, k in enumerate(keys)]
    return rows.join(want, same, "left_anti")
