"""Filters: one definition, one Spark predicate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from accountlake import vocab
from accountlake.config import DAYS, NO_VALUE, OPERATORS, Condition, FilterError, FilterSpec
from accountlake.functions.text import col

TABLE = "table"


def _instant(moment: datetime, data_type: T.DataType | None) -> Column:
    """A literal of the column's own type, so that the comparison reaches the scan."""
    moment = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
    if isinstance(data_type, T.TimestampNTZType):
        naive = moment.astimezone(timezone.utc).replace(tzinfo=None)
        return F.lit(naive.isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(data_type, (T.LongType, T.IntegerType)):
        return F.lit(int(moment.timestamp() * 1000))
    return F.lit(moment)


def condition(
    cond: Condition,
    column: str | None = None,
    *,
    now: datetime | None = None,
    data_type: T.DataType | None = None,
) -> Column:
    """One clause as a predicate; SQL null logic, widened by ``or_unknown``."""
    c, op = F.col(column or cond.field), cond.op
    if op == "is_known":
        return c.isNotNull()
    if op == "is_unknown":
        return c.isNull()
    if op in DAYS:
        cutoff = _instant((now or datetime.now(timezone.utc)) - timedelta(days=cond.value), data_type)
        clause = c < cutoff if op == "older_than_days" else c > cutoff
    elif op == "in":
        clause = c.isin(*cond.values)
    elif op == "not_in":
        clause = ~c.isin(*cond.values)
    elif op == "contains":
        clause = c.contains(str(cond.value))
    elif op == "equals":
        clause = c == F.lit(cond.value)
    elif op == "not_equals":
        clause = c != F.lit(cond.value)
    elif op == "greater_than":
        clause = c > F.lit(cond.value)
    else:
        clause = c < F.lit(cond.value)
    return clause | c.isNull() if cond.or_unknown else clause


def condition_problem(op: Column | str, value: Column | str) -> Column:
    """Why a condition would be refused, by its operator and its value as JSON text; null for a good one.

    The messages are those of ``Condition``, for tables of conditions that are checked before a run.
    """
    op, value = col(op), col(value)
    parsed = F.try_parse_json(value)
    none = value.isNull() | parsed.isNull() | F.is_variant_null(parsed)
    name = F.concat(F.lit("operator '"), op, F.lit("' "))
    number = F.schema_of_variant(parsed).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return (
        F.when(op.isNull() | ~op.isin(*OPERATORS), F.concat(
            F.lit("unknown operator '"), F.coalesce(op, F.lit("None")), F.lit(f"'; use one of {', '.join(OPERATORS)}")))
        .when(op.isin(*NO_VALUE) & ~none, F.concat(name, F.lit("takes no value")))
        .when(~op.isin(*NO_VALUE) & none, F.concat(name, F.lit("needs a value")))
        .when(op.isin(*DAYS) & ~number, F.concat(name, F.lit("needs a number of days")))
    )


def _all(clauses: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, clauses) if clauses else F.lit(True)


def _any(clauses: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, clauses) if clauses else F.lit(False)


def predicate(
    spec: FilterSpec,
    *,
    system: str = TABLE,
    now: datetime | None = None,
    schema: T.StructType | None = None,
) -> Column:
    """The whole filter as one boolean column. Raw text or raw groups replace the conditions."""
    now = now or datetime.now(timezone.utc)
    types = {f.name: f.dataType for f in schema} if schema is not None else {}

    def clause(cond: Condition, name: str) -> Column:
        return condition(cond, name, now=now, data_type=types.get(name))

    if system in spec.raw:
        raw = spec.raw[system]
        if isinstance(raw, str):
            return F.expr(raw) if raw else F.lit(True)
        return _any([_all([clause(c, c.field) for c in group]) for group in raw]) if raw else F.lit(True)
    return _all([clause(c, spec.column(c.field, system)) for c in spec.conditions])


def apply_filter(
    df: DataFrame, spec: FilterSpec, *, system: str = TABLE, now: datetime | None = None
) -> DataFrame:
    return df.where(predicate(spec, system=system, now=now, schema=df.schema))


def modified_since(df: DataFrame, column: str, last_run: datetime | None) -> DataFrame:
    """Only rows changed after the previous run started; everything on a first run.

    Applied on top of any filter, raw ones too.
    """
    if last_run is None:
        return df
    return df.where(F.col(column) > _instant(last_run, df.schema[column].dataType))


def to_dnf(spec: FilterSpec, max_groups: int = vocab.MAX_FILTER_GROUPS) -> list[list[Condition]]:
    """The filter as alternatives of plain conjunctions, for systems without "or is null".

    Every condition that an unknown value may satisfy is a yes-or-no choice, so the
    alternatives are the numbers below two to the count of these, read bit by bit.
    """
    wide = [i for i, c in enumerate(spec.conditions) if c.or_unknown and c.op not in NO_VALUE]
    if 1 << len(wide) > max_groups:
        raise FilterError(
            f"{len(wide)} conditions accept unknown values, which makes {1 << len(wide)} groups of at most {max_groups}; "
            "a raw predicate has no such bound"
        )
    bit = {i: len(wide) - 1 - n for n, i in enumerate(wide)}

    def member(i: int, number: int) -> Condition:
        cond = spec.conditions[i]
        if i in bit and number >> bit[i] & 1:
            return Condition(cond.field, "is_unknown")
        return replace(cond, or_unknown=False)

    return [[member(i, number) for i in range(len(spec.conditions))] for number in range(1 << len(wide))]


def dnf_filter(spec: FilterSpec, *, system: str = TABLE, max_groups: int = vocab.MAX_FILTER_GROUPS) -> FilterSpec:
    """An equivalent filter made of raw groups."""
    groups = [
        [replace(c, field=spec.column(c.field, system)) for c in group]
        for group in to_dnf(spec, max_groups)
    ]
    return replace(spec, raw={**spec.raw, system: groups})


# --- checks before running -------------------------------------------------


def _unresolved(df: DataFrame, text: str) -> list[str]:
    """Column names in raw predicate text that the table lacks; analysis only, no job."""
    missing: list[str] = []
    probe = df
    while True:
        try:
            probe.where(F.expr(text))
            return missing
        except AnalysisException as exc:
            if "UNRESOLVED_COLUMN" not in (exc.getCondition() or ""):
                raise
            name = (exc.getMessageParameters() or {}).get("objectName", "").replace("`", "")
            if not name or name in missing:
                raise
            missing.append(name)
            probe = probe.withColumn(name.split(".")[0], F.lit(None).cast("string"))


def preflight(df: DataFrame, spec: FilterSpec, *, domain_col: str = "domain", system: str = TABLE) -> list[str]:
    """Sorted names the filter (and the domain) need and the table lacks."""
    raw = spec.raw.get(system)
    wanted = {domain_col}
    if isinstance(raw, list):
        wanted |= {c.field for group in raw for c in group}
    elif raw is None:
        wanted |= {spec.column(c.field, system) for c in spec.conditions}
    missing = {name for name in wanted if name.split(".")[0] not in df.columns}
    if isinstance(raw, str) and raw:
        missing |= set(_unresolved(df, raw))
    return sorted(missing)


def preview(
    df: DataFrame, spec: FilterSpec, n: int = 10, *, domain_col: str = "domain",
    system: str = TABLE, now: datetime | None = None,
) -> tuple[list[str], DataFrame | None]:
    """What is missing, and the first ``n`` matches; nothing is written.

    ``rows.explain()`` on the second value shows the query that would run.
    """
    missing = preflight(df, spec, domain_col=domain_col, system=system)
    return missing, None if missing else apply_filter(df, spec, system=system, now=now).limit(n)
