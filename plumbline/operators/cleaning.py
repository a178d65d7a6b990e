"""Executing a cleaning plan: identifiers, missing values, duplicates, outliers, leakage check, encoding.

Steps that do not influence each other share one statistics pass: all
imputations between two row drops, and all caps up to and including the next
outlier removal. Statistics come back as a few numbers per column; the data
itself only passes through projections, filters and one de-duplication.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import vocab
from plumbline.operators.columns import BOOLEAN, DATETIME, NUMERIC, UNSUPPORTED, ColumnInfo, columns_of, ref
from plumbline.operators.correlation import leakage_flags
from plumbline.operators.duplicates import drop_duplicate_rows
from plumbline.operators.facts import value_counts
from plumbline.operators.frequency import typed_modes
from plumbline.operators.quantiles import column_quantiles
from plumbline.plans.cleaning_plan import DUPLICATES, ENCODING, MISSING, OUTLIERS, Step, plan_steps
from plumbline.session import settled, small_table

DROPPED, LEAKAGE = "dropped_columns", "leakage_warnings"
UNKNOWN_LABEL = "skipped - unknown or dropped column"
UNREAD_LABEL = "skipped - unrecognised action"
LOG_SCHEMA = (
    "ordinal int, section string, column string, requested string, executed string, reason string, "
    "confidence string, rows_removed bigint"
)


class CleaningError(Exception):
    """The plan leaves no rows or no columns."""


@dataclass
class Log:
    rows: list[tuple] = field(default_factory=list)

    def add(self, step: Step, executed: str | None, reason: str | None = None, removed: int | None = None) -> None:
        self.rows.append((
            len(self.rows), step.section, step.column, step.action, executed, reason or step.reason,
            step.confidence, removed))


@dataclass(frozen=True)
class CleanResult:
    encoded: DataFrame
    pre_encoding: DataFrame
    actions: DataFrame


def _info(df: DataFrame, name: str) -> ColumnInfo | None:
    return next((c for c in columns_of(df) if c.name == name), None)


def normalised(df: DataFrame) -> DataFrame:
    """The table with NaN cells as nulls."""
    return df.select(*[c.value.alias(c.name) for c in columns_of(df)])


# --- predicates and projections ----------------------------------------------


def drop_columns(df: DataFrame, names: Iterable[str], target: str | None = None) -> tuple[DataFrame, list[str]]:
    """Drop columns, but never the target and never every column."""
    present = [n for n in names if n in df.columns and n != target]
    if len(present) >= len(df.columns):
        present = []
    return df.select(*[ref(n) for n in df.columns if n not in set(present)]), present


def keep_in_range(df: DataFrame, name: str, low: float, high: float) -> DataFrame:
    """Rows whose value is null or within [low, high]."""
    c = ref(name)
    return df.where(c.isNull() | c.between(F.lit(low), F.lit(high)))


def clipped(c: ColumnInfo, low: float, high: float) -> Column:
    """Value clipped to [low, high]; nulls stay null. Decimals keep their type, so only cells outside change."""
    if isinstance(c.dtype, T.DecimalType):
        ends = [F.lit(x).cast(T.DecimalType(38, c.dtype.scale)) for x in (low, high)]
        return F.least(F.greatest(c.value, ends[0]), ends[1]).cast(c.dtype) if None not in (low, high) else c.value
    out = F.when(c.value.isNotNull(), F.least(F.greatest(c.number, F.lit(low)), F.lit(high)))
    whole = float(low).is_integer() and float(high).is_integer()
    return out.cast(c.dtype) if c.is_integral and whole else out


# --- statistics passes --------------------------------------------------------


def _extents(df: DataFrame, cols: Sequence[ColumnInfo]) -> dict[int, tuple]:
    row = df.agg(*[
        f(c.number).alias(f"{k}{c.ordinal}") for c in cols for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))
    ]).first()
    return {c.ordinal: tuple(row[f"{k}{c.ordinal}"] for k in ("n", "lo", "hi")) for c in cols}


def _quantiles(df: DataFrame, cols: Sequence[ColumnInfo], probs: Sequence[float]) -> dict[str, list[float]]:
    if not cols:
        return {}
    found = column_quantiles(df, cols, probs, _extents(df, cols))
    return {c.name: found[c.ordinal] for c in cols if c.ordinal in found}


def iqr_fences(df: DataFrame, cols: Sequence[ColumnInfo]) -> dict[str, tuple[float, float]]:
    """IQR fences per column with data."""
    return {
        name: (a - 1.5 * (b - a), b + 1.5 * (b - a)) for name, (a, b) in _quantiles(df, cols, (0.25, 0.75)).items()}


def _medians(df: DataFrame, cols: Sequence[ColumnInfo]) -> dict[str, float]:
    return {name: q[0] for name, q in _quantiles(df, cols, (0.5,)).items()}


def _filled(c: ColumnInfo, fill: object) -> Column:
    """Value with its nulls replaced; present cells are never touched."""
    if c.kind == DATETIME:
        literal = F.timestamp_micros(F.lit(fill).cast("bigint")) if not c.dtype.simpleString() == "date" else (
            F.date_from_unix_date(F.lit(fill).cast("int")))
        return F.coalesce(c.value, literal.cast(c.dtype))
    if c.kind == BOOLEAN:
        return F.coalesce(c.value, F.lit(bool(fill)))
    if c.is_integral and float(fill).is_integer():
        return F.coalesce(c.value, F.lit(int(fill)).cast(c.dtype))
    if isinstance(c.dtype, T.DecimalType):  # present cells keep every digit; the fill is rounded to the column's scale
        return F.coalesce(c.value, F.lit(float(fill)).cast(c.dtype))
    if c.kind == NUMERIC:
        return F.coalesce(c.number, F.lit(float(fill)))
    return F.coalesce(c.value, F.lit(fill).cast(c.dtype))


# --- steps --------------------------------------------------------------------


def impute(df: DataFrame, wanted: Sequence[tuple[str, str]]) -> DataFrame:
    """Fill the nulls of columns with their median or mode.

    A text column asked for its median gets its mode. A column with nulls first
    gets a 0/1 indicator ``<column>_missing``, appended at the end.
    """
    cols = {c.name: c for c in columns_of(df) if c.kind != UNSUPPORTED}
    wanted = [(n, how) for n, how in wanted if n in cols]
    if not wanted:
        return df
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[
        F.count(cols[n].value).alias(f"n{cols[n].ordinal}") for n, _ in wanted]).first()
    gaps = [(n, how) for n, how in wanted if counts[f"n{cols[n].ordinal}"] < counts["rows"]]
    if not gaps:
        return df
    by_median = [cols[n] for n, how in gaps if how == "median" and cols[n].kind == NUMERIC]
    by_mode = [cols[n] for n, how in gaps if cols[n] not in by_median]
    fills: dict[str, object] = dict(_medians(df, by_median))
    if by_mode:
        fills.update(typed_modes(df, by_mode))
    out, names = [], set(df.columns)
    for c in columns_of(df):
        fill = fills.get(c.name)
        out.append((_filled(c, fill) if fill is not None else ref(c.name)).alias(c.name))
    for n, _ in gaps:
        if f"{n}_missing" not in names:
            out.append(cols[n].value.isNull().cast("int").alias(f"{n}_missing"))
    return df.select(*out)


def _apply_missing(df: DataFrame, steps: Sequence[Step], target: str | None, log: Log) -> DataFrame:
    waiting: list[tuple[str, str]] = []
    counted: dict[str, int] | None = None
    for step in steps:
        name, action = step.column, step.action
        if name == target and target is not None:
            log.add(step, vocab.TARGET_KEPT_LABEL)
        elif name not in df.columns:
            log.add(step, UNKNOWN_LABEL)
        elif action not in ("median", "mode", "drop"):
            log.add(step, UNREAD_LABEL)
        elif action != "drop":
            waiting.append((name, action))
            log.add(step, action)
        else:
            if counted is None:
                # One pass for every drop still ahead; valid until rows are dropped.
                ahead = [_info(df, s.column) for s in steps if s.action == "drop" and s.column in df.columns]
                row = df.agg(F.count(F.lit(1)).alias("rows"), *[
                    F.count(c.value).alias(f"n{c.ordinal}") for c in ahead]).first()
                counted = {c.name: row["rows"] - row[f"n{c.ordinal}"] for c in ahead} | {None: row["rows"]}
            total, missing = counted[None], counted[name]
            if total > 0 and missing / total > vocab.MAX_ROW_DROP_SHARE:
                df, _ = drop_columns(df, [name])
                waiting = [w for w in waiting if w[0] != name]
                log.add(
                    Step(DROPPED, name, "drop_column", None, "High"), "drop_column",
                    vocab.COLUMN_DROP_REASON.format(pct=missing / total * 100, missing=missing, total=total))
                log.add(step, "drop_column")
            else:
                df, waiting = impute(df, waiting), []
                df = df.where(_info(df, name).value.isNotNull())
                counted = None
                log.add(step, "drop", removed=missing)
    return impute(df, waiting)


def _apply_outliers(df: DataFrame, steps: Sequence[Step], target: str | None, log: Log) -> DataFrame:
    if not steps:
        return df
    enough = df.limit(vocab.MIN_ROWS_FOR_OUTLIERS).count() >= vocab.MIN_ROWS_FOR_OUTLIERS
    batch: list[Step] = []

    def run(frame: DataFrame) -> DataFrame:
        cols = {c.name: c for c in columns_of(frame)}
        fences = iqr_fences(frame, [cols[s.column] for s in batch]) if batch else {}
        caps, removal = {}, None
        for s in batch:
            if s.column not in fences:
                log.add(s, vocab.OUTLIER_SKIPPED_LABEL)
                continue
            log.add(s, s.action)
            if s.action == "cap":
                caps[s.column] = clipped(cols[s.column], *fences[s.column])
            else:
                removal = s.column
        frame = frame.select(*[caps.get(n, ref(n)).alias(n) for n in frame.columns])
        if removal is not None:
            frame = keep_in_range(frame, removal, *fences[removal])
        batch.clear()
        return frame

    for step in steps:
        name, action = step.column, step.action
        info = _info(df, name)
        if name == target and target is not None:
            log.add(step, vocab.TARGET_KEPT_LABEL)
        elif info is None:
            log.add(step, UNKNOWN_LABEL if action not in ("cap", "remove") else vocab.OUTLIER_SKIPPED_LABEL)
        elif action == "keep":
            log.add(step, "keep")
        elif action not in ("cap", "remove"):
            log.add(step, UNREAD_LABEL)
        elif not enough or info.kind != NUMERIC:
            log.add(step, vocab.OUTLIER_SKIPPED_LABEL)
        else:
            batch.append(step)
            if action == "remove":
                df = run(df)
    return run(df) if batch else df


def _shown(c: ColumnInfo, v: object) -> str:
    """Text of a value in a column name."""
    if c.kind == BOOLEAN:
        return "true" if v else "false"
    if isinstance(c.dtype, T.DateType):
        return (date(1970, 1, 1) + timedelta(days=v)).isoformat()
    if c.kind == DATETIME:
        return str(datetime(1970, 1, 1) + timedelta(microseconds=v))
    return str(v)


def one_hot(
    df: DataFrame, names: Sequence[str], limit: int = vocab.MAX_CATEGORIES, ratio: float = vocab.MAX_ENCODE_RATIO
) -> tuple[DataFrame, list[str]]:
    """Replace columns by 0/1 columns ``<column>_<value>``, one per sorted value.

    A null gets 0 everywhere. Columns with more than ``limit`` values, or in
    tables of up to twice that many rows with more values than ``ratio`` of the
    rows, are left alone; only the kept values reach the driver. Returns the
    columns encoded. Timestamps are named in UTC.
    """
    cols = [c for n in names for c in columns_of(df) if c.name == n and c.kind != UNSUPPORTED]
    if not cols:
        return df, []
    found: dict[int, list] = {}
    for part in value_counts(df, cols):
        order = Window.partitionBy("ordinal").orderBy("v")
        few = part.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= limit + 1)
        for r in few.orderBy("ordinal", "rk").collect():
            found.setdefault(r["ordinal"], []).append(r["v"])
    # The ratio guard can only bite below twice the value limit.
    rows = df.limit(2 * limit + 1).count()
    keep = [
        c for c in cols
        if len(found.get(c.ordinal, [])) <= limit
        and not (rows <= 2 * limit and len(found.get(c.ordinal, [])) > rows * ratio)
    ]
    chosen = {c.name for c in keep}
    out = [ref(n) for n in df.columns if n not in chosen]
    for c in keep:
        for v in found.get(c.ordinal, []):
            out.append(c.family_value.eqNullSafe(F.lit(v).cast(c.family)).cast("int").alias(f"{c.name}_{_shown(c, v)}"))
    return df.select(*out), [c.name for c in keep]


def _apply_encoding(df: DataFrame, steps: Sequence[Step], target: str | None, log: Log) -> DataFrame:
    todo: list[Step] = []
    done = {}
    for step in steps:
        if step.column == target and target is not None:
            done[step] = vocab.TARGET_KEPT_LABEL
        elif step.column not in df.columns:
            done[step] = vocab.ENCODING_SKIPPED_LABEL if step.action == "one_hot" else UNKNOWN_LABEL
        elif step.action == "none":
            done[step] = "none"
        elif step.action != "one_hot":
            done[step] = UNREAD_LABEL
        else:
            todo.append(step)
    df, encoded = one_hot(df, [s.column for s in todo])
    for step in steps:
        log.add(step, done.get(step) or (
            "one_hot" if step.column in encoded else vocab.ENCODING_SKIPPED_LABEL))
    return df


def _require_rows(df: DataFrame, after: str) -> None:
    if not df.columns:
        raise CleaningError(f"Cleaning left the dataset with no columns after {after}.")
    if df.isEmpty():
        raise CleaningError(
            f"Cleaning left the dataset with no rows after {after}. The cleaning plan was too aggressive for this data.")


def clean(
    df: DataFrame, plan, target: str | None = None, identifiers: Iterable[str] = ()
) -> CleanResult:
    """Run a plan: identifiers, missing values, duplicates, outliers, leakage check, encoding.

    The target is never imputed, clipped, filtered on or encoded. ``plan`` is a
    dict, JSON text or plan rows; a malformed plan applies nothing. The rows
    left by de-duplication are written to the shared folder once, counted by that
    write, so that later statistics do not repeat its shuffle and read only the
    columns they need.
    """
    spark = df.sparkSession
    steps = plan_steps(spark, plan)
    log = Log()

    def section(name: str) -> list[Step]:
        return [s for s in steps if s.section == name]

    current, dropped = drop_columns(normalised(df), identifiers, target)
    for name in dropped:
        log.add(Step(DROPPED, name, "drop_column", None, "High"), "drop_column", vocab.IDENTIFIER_REASON)

    if section(MISSING):
        current = _apply_missing(current, section(MISSING), target, log)
        _require_rows(current, "missing-value handling")

    for step in section(DUPLICATES):
        if step.action == "drop":
            before = current.count()
            current, left = settled(drop_duplicate_rows(current))
            log.add(step, "drop", removed=before - left)
        else:
            log.add(step, "keep" if step.action == "keep" else UNREAD_LABEL)

    if section(OUTLIERS):
        current = _apply_outliers(current, section(OUTLIERS), target, log)
        _require_rows(current, "outlier removal")

    if target is not None:
        for row in leakage_flags(current, target).orderBy("ordinal").collect():
            log.add(Step(LEAKAGE, row["column"], "flag", None, "High"), "flag",
                    vocab.LEAKAGE_REASON.format(target=target))

    encoded = _apply_encoding(current, section(ENCODING), target, log) if section(ENCODING) else current
    return CleanResult(encoded, current, small_table(spark, log.rows, LOG_SCHEMA))
