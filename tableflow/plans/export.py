"""Custom transform steps, fan-out and the export job
(source -> declared schema -> {CSV target, custom step}).

A job graph is plain function composition over DataFrames; there is no
graph interpreter.  Named frames travel in ``dict[str, DataFrame]``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from tableflow.session import shared_dir
from tableflow.sinks.csv import guarded_csv_export, write_csv
from tableflow.sources.jdbc import read_jdbc
from tableflow.sources.schema import SchemaLike, apply_schema

Frames = dict[str, DataFrame]
Step = Callable[[SparkSession, Frames], Frames]


def custom_transform(spark: SparkSession, step: Step, frames: Mapping[str, DataFrame]) -> Frames:
    """Run a user step: named frames in, named frames out (checked)."""
    out = step(spark, dict(frames))
    if not isinstance(out, dict) or not all(isinstance(v, DataFrame) for v in out.values()):
        raise TypeError("a custom step must return dict[str, DataFrame]")
    return out


def guarded_export_step(
    input_name: str, path: str, output_name: str = "out", num_files: int | None = None
) -> Step:
    """The export step: take ``frames[input_name]``, overwrite ``path`` with
    it as header-less CSV if it has a row (else keep the old output), and
    return it unchanged as ``output_name``."""

    def step(_spark: SparkSession, frames: Frames) -> Frames:
        df, _ = guarded_csv_export(frames[input_name], path, num_files=num_files)
        return {output_name: df}

    return step


def fan_out(
    df: DataFrame,
    branches: Mapping[str, Callable[[DataFrame], object]],
    persist: bool | str = False,
    storage_level: StorageLevel = StorageLevel.MEMORY_AND_DISK,
) -> dict[str, object]:
    """Feed one frame to several consumers.

    ``persist`` picks how the shared source is held:

    * ``True`` / ``"persist"``: executors' block stores (memory, spilling to
      disk).  A lost executor's blocks are recomputed from lineage.
    * ``"checkpoint"``: a reliable checkpoint in the shared checkpoint
      folder; lineage is cut, so a lost executor never re-reads the source
      (the choice for a database source, or one too large to cache).
    * ``False`` / ``"none"``, the default: every branch re-evaluates the
      source (cheapest when re-reading is cheap, e.g. Parquet; nothing is
      copied to executors' disks).

    A cache made here is released when all branches finished; a frame that
    the caller had cached stays cached.
    """
    mode = {True: "persist", False: "none"}.get(persist, persist)
    own_cache = mode == "persist" and not df.is_cached
    if mode == "persist":
        shared = df.persist(storage_level) if own_cache else df
    elif mode == "checkpoint":
        shared_dir(df.sparkSession)  # make sure a checkpoint folder is registered
        shared = df.checkpoint(eager=True)
    elif mode == "none":
        shared = df
    else:
        raise ValueError(f"unknown persist mode {persist!r}")
    try:
        return {name: branch(shared) for name, branch in branches.items()}
    finally:
        if own_cache:
            shared.unpersist()


@dataclass(frozen=True)
class ExportJob:
    """The export graph: one source with a declared schema feeding a CSV
    target and the export step.

    ``target_files=None`` writes one file per partition; the single-file
    layout (``1``) funnels the whole table through one writer task, so use
    it only for outputs known to be small.
    """

    schema: SchemaLike
    target_path: str
    step_path: str
    source_name: str = "source"
    target_files: int | None = None
    compression: str = "none"
    persist: bool | str = False

    def run(self, spark: SparkSession, source: DataFrame) -> Frames:
        typed = apply_schema(source, self.schema)

        def target(df: DataFrame) -> str:
            return write_csv(
                df, self.target_path, mode="overwrite",
                num_files=self.target_files, compression=self.compression,
            )

        def step(df: DataFrame) -> Frames:
            return custom_transform(
                spark, guarded_export_step(self.source_name, self.step_path), {self.source_name: df}
            )

        results = fan_out(typed, {"target": target, "step": step}, persist=self.persist)
        return {"typed": typed, **results["step"]}

    def run_from_jdbc(self, spark: SparkSession, url: str, table: str, **jdbc_kwargs) -> Frames:
        """The graph as declared: a JDBC table source (see
        ``sources.jdbc.jdbc_options`` for the split settings), read once:
        without another choice the rows are held by a reliable checkpoint."""
        job = self if self.persist else replace(self, persist="checkpoint")
        return job.run(spark, read_jdbc(spark, url, table, **jdbc_kwargs))
