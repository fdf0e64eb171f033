"""Definition sync as one Spark job: which definitions to create or
overwrite in a target, after renaming, rule checks, clean-up and
placeholder substitution.

Steps, each an operator from this package:

1. last definition per name wins (``keep_last``);
2. every requested name is looked up, unknown names are reported
   (``lookup_report``);
3. names get the environment prefix, script paths the prefix behind the
   script folder marker (``prefix_names``, ``infix_path``);
4. skip rules tag rows that must not be synced (``skip_reason``);
5. system fields are dropped (``drop_fields``), placeholders substituted in
   every string value but the name, map keys untouched
   (``substitute_nested``);
6. the create / overwrite / keep action against the target's names, asked
   for by the prefixed, unsubstituted name (``sync_plan``); skipped and
   unknown rows get no action.  A created job's own name is substituted, a
   connection's (``substitute_name=False``) is not.

Nothing is written: the result is the plan (the dry run), and applying it
is an ``upsert`` / ``insert_missing`` of the rows with an action.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableflow.functions.nested import substitute_nested
from tableflow.functions.text import infix_path, substitute
from tableflow.operators.filters import parse_name_list, skip_reason
from tableflow.operators.joins import lookup_report
from tableflow.operators.names import quote
from tableflow.operators.project import default_map_field, drop_fields
from tableflow.operators.quality import keep_last
from tableflow.operators.reconcile import sync_plan, upsert

# Fields of a definition the target assigns itself.
JOB_SYSTEM_FIELDS = ("AllocatedCapacity", "MaxCapacity", "CreatedOn", "LastModifiedOn")
CONNECTION_SYSTEM_FIELDS = (
    "CreationTime", "LastConnectionValidationTime", "LastUpdatedBy", "LastUpdatedTime",
    "ConnectionSchemaVersion", "Status", "StatusReason",
)


@dataclass(frozen=True)
class DefinitionSync:
    mapping: Sequence[tuple[str, str]] = ()
    name_prefix: str = ""
    name_column: str = "Name"
    script_field: tuple[str, str] | None = ("Command", "ScriptLocation")
    script_marker: str = "/scripts/"
    skip_rules: Sequence[tuple[str, Column]] = ()
    system_fields: Sequence[str] = JOB_SYSTEM_FIELDS
    allow_overwrite: bool = True
    order_by: Sequence[str] = field(default_factory=tuple)
    # map fields that must exist: absent or null becomes an empty map
    default_maps: Sequence[str] = ()
    # whether a created definition's own name is substituted too (jobs), or
    # keeps the name it was looked up by (connections)
    substitute_name: bool = True

    def plan(
        self,
        definitions: DataFrame,
        target_names: DataFrame,
        requested: DataFrame | str | None = None,
    ) -> DataFrame:
        """Columns: ``requested_name``, ``found``, ``skip_reason``,
        ``action``, then the cleaned definition.  ``requested`` is a
        one-column frame of names, a comma list, or ``None`` (every
        definition).  ``target_names`` holds the target's (prefixed) names
        in its first column."""
        name = self.name_column
        defs = keep_last(definitions, name, self.order_by) if self.order_by else definitions
        spark = definitions.sparkSession
        if requested is None:
            # every definition is requested: found by construction, no join
            report = defs.select(
                F.col(name).alias("requested_name"), F.lit(True).alias("found"), *defs.columns
            )
        elif isinstance(requested, DataFrame):
            names = requested.select(F.col(requested.columns[0]).alias("requested_name"))
            report = lookup_report(names, "requested_name", defs, name)
        else:
            # A command-line list; unknown names are reported too.
            listed = parse_name_list(requested) or []
            names = spark.createDataFrame([(n,) for n in listed], "requested_name string")
            report = lookup_report(names, "requested_name", defs, name, names_are_small=True)

        # rules see the definition as stored in the source
        reason = F.when(F.col("found"), skip_reason(list(self.skip_rules)))
        out = report.withColumn("skip_reason", reason)
        if self.name_prefix:
            out = out.withColumn(name, F.concat(F.lit(self.name_prefix), F.col(name)))
            if self.script_field is not None:
                struct, leaf = self.script_field
                out = out.withColumn(
                    struct,
                    F.col(struct).withField(
                        leaf, infix_path(F.col(struct).getField(leaf), self.name_prefix, self.script_marker)
                    ),
                )
        out = drop_fields(out, list(self.system_fields))
        for map_field in self.default_maps:
            out = default_map_field(out, map_field)
        keep_cols = [c for c in out.columns if c not in ("requested_name", "found", "skip_reason")]
        # The target is asked for the prefixed name as it stands; only the
        # payload is substituted.
        payload = [c for c in keep_cols if c != name]
        out = substitute_nested(out, list(self.mapping), columns=payload)

        target = target_names.select(F.col(target_names.columns[0]).alias(name))
        planned = sync_plan(out, target, name, allow_overwrite=self.allow_overwrite)
        if self.substitute_name:
            created = F.when(F.col("action") == "create", substitute(name, list(self.mapping)))
            planned = planned.withColumn(name, created.otherwise(F.col(name)))
        action = F.when(F.col("found") & F.col("skip_reason").isNull(), F.col("action"))
        return planned.select(
            "requested_name", "found", "skip_reason", action.alias("action"), *keep_cols
        )


def apply_plan(
    target: DataFrame, plan: DataFrame, keys: str | Sequence[str], action_column: str = "action"
) -> DataFrame:
    """The target after carrying out a plan: rows planned ``create`` or
    ``overwrite`` replace / join the target (whole rows), everything else
    stays.  Plan columns that the target lacks are left out.  Write the
    result to a new location."""
    chosen = plan.filter(F.col(action_column).isin("create", "overwrite"))
    return upsert(target, chosen.select(*map(quote, target.columns)), keys)
