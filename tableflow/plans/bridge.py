"""The bridge-join job: organisations, persons and memberships (JSON files)
joined through the membership table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tableflow.operators.joins import bridge_join
from tableflow.operators.project import drop_fields, rename_fields
from tableflow.sources.json import read_json
from tableflow.sources.schema import SchemaLike


def prepare_orgs(
    orgs: DataFrame, drop: Sequence[str], renames: Sequence[tuple[str, str]]
) -> DataFrame:
    """Drop the fields that would collide or are not wanted, then rename the
    org key and name so they cannot clash with person fields."""
    return rename_fields(drop_fields(orgs, drop), renames)


def bridge_job(
    orgs: DataFrame,
    persons: DataFrame,
    memberships: DataFrame,
    org_drop: Sequence[str],
    org_renames: Sequence[tuple[str, str]],
    person_key: str,
    membership_person_key: str,
    org_key: str,
    membership_org_key: str,
    first: str = "orgs",
) -> DataFrame:
    """``prepare_orgs`` then ``bridge_join``; the membership's person key and
    the org key are dropped from the result."""
    return bridge_join(
        prepare_orgs(orgs, org_drop, org_renames),
        persons,
        memberships,
        person_key,
        membership_person_key,
        org_key,
        membership_org_key,
        first=first,
    )


def bridge_job_from_json(
    spark: SparkSession,
    orgs_path: str,
    persons_path: str,
    memberships_path: str,
    schemas: tuple[SchemaLike | None, SchemaLike | None, SchemaLike | None] = (None, None, None),
    **job_args,
) -> DataFrame:
    """The same over three JSON inputs (folders are read recursively)."""
    orgs, persons, members = (
        read_json(spark, p, schema=s)
        for p, s in zip((orgs_path, persons_path, memberships_path), schemas)
    )
    return bridge_job(orgs, persons, members, **job_args)
