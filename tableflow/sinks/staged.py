"""CSV export that evaluates its input once: staged, counted and checked while
it is written, and published only if it holds up.

``guarded_csv_export`` asks first whether there is a row and then writes, so its
input runs twice.  Here the rows are written to a folder beside the target while
``DataFrame.observe`` counts them and every check's failures along the way; the
folder then takes the target's place, or goes and leaves the old output.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tableflow.operators.names import quote as quote_name
from tableflow.sinks import files
from tableflow.sinks.csv import CSV_ESCAPE, CSV_QUOTE, _shape, write_csv
from tableflow.sinks.formats import TEXT_TIME_OPTIONS

REPORT = "check_name STRING, n_rows BIGINT, n_failed BIGINT, passed BOOLEAN"


@dataclass(frozen=True)
class Published:
    """Whether the rows are the target now, how many there were, and for each
    check how many failed it."""

    written: bool
    n_rows: int
    failed: dict[str, int]

    @property
    def passed(self) -> bool:
        return not any(self.failed.values())

    def report(self, spark: SparkSession) -> DataFrame:
        """One row per check, as ``quality.expect_predicates`` has them."""
        return spark.createDataFrame([(k, self.n_rows, n, n == 0) for k, n in self.failed.items()], REPORT)


def publish_csv(
    df: DataFrame,
    path: str,
    checks: Sequence[tuple[str, Column]] = (),
    gate: bool = False,
    num_files: int | None = None,
    strategy: str = "repartition",
    header: bool = False,
) -> Published:
    """Overwrite ``path`` with ``df`` as CSV if it has a row (and, with
    ``gate``, if every row passes every check); else the old output stays.  A
    row fails a check when its predicate is false or null.

    The counts are taken in the stage that writes the files, whose tasks count
    once however often they are run."""
    seen = Observation()
    shaped = _shape(df, num_files, strategy)
    counts = [F.count(F.lit(1)).alias("n_rows")]
    counts += [F.count_if(~F.coalesce(p, F.lit(False))).alias(f"failed_{i}") for i, (_, p) in enumerate(checks)]
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    try:
        write_csv(shaped.observe(seen, *counts), staged, header=header)
        got = seen.get
        n_rows = got["n_rows"]
        failed = {name: got[f"failed_{i}"] for i, (name, _) in enumerate(checks)}
        written = n_rows > 0 and not (gate and any(failed.values()))
        if written:
            files.swap_in(df.sparkSession, staged, path)
    finally:
        files.delete(df.sparkSession, staged)
    return Published(written, n_rows, failed)


@dataclass(frozen=True)
class CsvBranch:
    """One consumer of ``publish_branches``: its rows and columns, and whether
    an empty result leaves the old output (``guarded``)."""

    path: str
    columns: Sequence[str | Column] = ("*",)
    where: Column | None = None
    guarded: bool = False


def publish_branches(df: DataFrame, branches: Mapping[str, CsvBranch]) -> dict[str, Published]:
    """Write several CSV outputs of one frame in one pass over it, for a source
    that must not be read twice (a database, a snapshot that moves).

    Each row becomes a line per branch that wants it; one write deals the lines
    to a staged folder per branch, counting them on the way, and the folders
    are then published one after the other.  ``plans.export.fan_out`` gives the
    same files, but evaluates or holds the frame."""
    names = list(branches)
    lines = []
    for i, name in enumerate(names):
        own = df.select(*branches[name].columns).schema.names
        chosen = [F.col(quote_name(c)) for c in own] if branches[name].columns == ("*",) else [F.col(quote_name(c)) if isinstance(c, str) else c for c in branches[name].columns]
        line = F.coalesce(F.to_csv(F.struct(*[c.alias(n) for c, n in zip(chosen, own)]), {"quote": CSV_QUOTE, "escape": CSV_ESCAPE, "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", **TEXT_TIME_OPTIONS}), F.lit(""))
        one = F.struct(F.lit(i).alias("branch"), line.alias("value"))
        lines.append(one if branches[name].where is None else F.when(branches[name].where, one))
    seen = Observation()
    counts = [F.count_if(F.col("branch") == i).alias(f"n{i}") for i in range(len(names))]
    rows = df.select(F.explode(F.array_compact(F.array(*lines))).alias("line")).select("line.*").observe(seen, *counts)
    spark, first = df.sparkSession, branches[names[0]].path.rstrip("/")
    staged = f"{first}.staged-{uuid.uuid4().hex}"
    out = {}
    try:
        rows.write.partitionBy("branch").text(staged)
        got = seen.get
        for i, name in enumerate(names):
            n, path = got[f"n{i}"], branches[name].path
            written = n > 0 or not branches[name].guarded
            if n:
                files.swap_in(spark, f"{staged}/branch={i}", path)
            elif written:  # an output without rows
                spark.createDataFrame([], "value STRING").write.mode("overwrite").text(path)
            out[name] = Published(written, n, {})
    finally:
        files.delete(spark, staged)
    return out
