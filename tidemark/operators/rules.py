"""Row rules of the stage tables: what each row breaks, good rows apart from the rest, and examples.

A rule is a field's name and what is asked of it: ``missing`` (the table has no such column), ``null`` (a required
value is null), ``type`` (a value that isn't of the field's kind), ``low``, ``high`` (out of bounds; NaN is out of
any bound) or ``value`` (not one of the allowed ones). All rules are one array expression on the row, so a table is
checked in one pass, without a shuffle. Further columns are allowed and kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

KIND = {"text": "string", "number": "double", "whole": "bigint", "flag": "boolean"}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    required: bool = True
    low: float | None = None
    high: float | None = None
    allowed: tuple[str, ...] = ()


def _optional(kind: str, *names: str) -> tuple[Field, ...]:
    return tuple(Field(n, kind, False) for n in names)


def _required(kind: str, *names: str) -> tuple[Field, ...]:
    return tuple(Field(n, kind) for n in names)


_PAIR = _required("text", "pair", "numerator", "denominator")
# The fields of each stage's rows and their bounds.
FIELDS: dict[str, tuple[Field, ...]] = {
    "s1": (*_PAIR, Field("passed", "flag"), Field("halflife", "number", False), Field("window", "whole", False, low=1), Field("method", "text")),
    "s2": (
        *_PAIR, Field("halflife", "number", False), Field("window", "whole", False, low=1), *_required("number", "entry_thresh", "exit_thresh"), Field("stop_pct", "number", low=0),
        *_required("number", "slope_min", "is_sharpe", "is_penalized_sharpe"), Field("is_trades", "whole", low=0), Field("oos_sharpe", "number"), Field("oos_trades", "whole", low=0),
        Field("passed", "flag"), *_required("text", "signal_method", "optim_method"),
    ),
    "s3": (
        *_PAIR, Field("mean_test_sharpe", "number"), Field("std_test_sharpe", "number", low=0), Field("n_test_periods", "whole", low=1), Field("n_oos_bars", "whole", False, low=0),
        *_required("number", "baseline_sharpe", "degradation"), Field("passed", "flag"), Field("val_method", "text"),
    ),
    "s4": (
        *_PAIR, Field("passed", "flag"), Field("tier", "text", allowed=("TOP_TIER", "SECOND_TIER", "REJECT", "GOOD", "MARGINAL")), Field("psr_value", "number", False, 0, 1), Field("dsr_value", "number", False, 0, 1),
        Field("bootstrap_lower_ci", "number", False), *_optional("flag", "psr_pass", "psr_pass_strict", "dsr_pass", "dsr_pass_strict", "passed_s4", "passed_s4_strict"),
    ),
    "s5": (
        Field("scheme_name", "text"), Field("cohort", "text", allowed=("singles", "ratios", "combined")), Field("oos_sr_full", "number"), *_optional("number", "oos_sr_active", "oos_sr_haircut"), Field("oos_cagr", "number"),
        Field("oos_max_dd", "number", high=0), *_optional("number", "oos_calmar", "ir_vs_spy", "alpha", "beta"), Field("n_units", "whole", low=1),
    ),
}


class SchemaError(ValueError):
    """Rows that break rules; ``examples`` holds (rule, row as JSON)."""

    def __init__(self, stage: str, counts: dict[str, int], examples: list[tuple[str, str]]):
        self.stage, self.counts, self.examples = stage, counts, examples
        lines = [f"{rule}: {n} rows, for example {', '.join(r for k, r in examples if k == rule)}" for rule, n in sorted(counts.items())]
        super().__init__(f"{stage}: rows break {len(counts)} rules\n  " + "\n  ".join(lines))


def fields_of(stage: str) -> tuple[Field, ...]:
    if stage not in FIELDS:
        raise KeyError(f"no rules for stage {stage!r}; there are {', '.join(sorted(FIELDS))}")
    return FIELDS[stage]


def _column(name: str) -> Column:
    return F.col(f"`{name}`")


def broken_by(df: DataFrame, field: Field) -> list[tuple[str, Column]]:
    """(rule, where a row breaks it) of one field."""
    if field.name not in df.columns:
        return [(f"{field.name}: missing", F.lit(True))] if field.required else []
    x, kind = _column(field.name), df.schema[field.name].dataType.simpleString()
    value = x if kind == KIND[field.kind] else F.expr(f"try_cast(`{field.name}` AS {KIND[field.kind]})")
    wrong = value.isNull()
    if field.kind == "whole" and kind in ("double", "float", "string"):
        real = F.expr(f"try_cast(`{field.name}` AS double)")
        value, wrong = real, real.isNull() | F.isnan(real) | (real != F.floor(real))
    out = [(f"{field.name}: null", x.isNull())] if field.required else []
    if kind != KIND[field.kind] and field.kind != "text":
        out.append((f"{field.name}: type", x.isNotNull() & wrong))
    # NaN is above every number for Spark, so a lower bound needs to name it.
    nan = F.isnan(value) if field.kind in ("number", "whole") and kind in ("double", "float") else F.lit(False)
    if field.low is not None:
        out.append((f"{field.name}: low", (value < field.low) | nan))
    if field.high is not None:
        out.append((f"{field.name}: high", (value > field.high) | nan))
    if field.allowed:
        out.append((f"{field.name}: value", ~x.isin(*field.allowed)))
    return out


def broken_rules(df: DataFrame, stage: str) -> Column:
    """The rules that a row breaks, in the order of the fields."""
    found = [F.when(F.coalesce(where, F.lit(False)), F.lit(rule)) for f in fields_of(stage) for rule, where in broken_by(df, f)]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def check_rows(df: DataFrame, stage: str, to: str = "broken") -> DataFrame:
    """``df`` with the array of broken rules."""
    if to in df.columns:
        raise ValueError(f"there is a column {to!r} already")
    return df.withColumn(to, broken_rules(df, stage))


def rule_counts(checked: DataFrame, broken: str = "broken") -> DataFrame:
    """(rule, n): rows that break each rule; a row may break several."""
    return checked.select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def examples(checked: DataFrame, most: int = 5, broken: str = "broken") -> DataFrame:
    """(rule, row): up to ``most`` rows of each rule as JSON, those with the smallest hashes.

    Each task keeps its own best few before the shuffle, however many rows break a rule.
    """
    row = F.to_json(F.struct(*[_column(c) for c in checked.columns if c != broken]), {"ignoreNullFields": "false"})
    each = checked.filter(F.size(broken) > 0).select(F.explode(broken).alias("rule"), row.alias("row"))
    order = W.partitionBy("rule").orderBy(F.xxhash64("row"), "row")
    return each.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r")


@dataclass
class Split:
    """Good rows, bad ones with what they break, counts and examples; all read what one pass has written."""

    good: DataFrame
    bad: DataFrame
    counts: DataFrame
    examples: DataFrame


def split_rows(df: DataFrame, stage: str, folder: str, strict: bool = False, most: int = 5) -> Split:
    """Writes ``df`` once, into ``folder``/ok=true and ok=false, and ``folder``-examples with up to ``most`` rows
    a rule. Strict: bad rows raise SchemaError with those examples, after they have been written."""
    spark, place = df.sparkSession, folder.rstrip("/")
    checked = check_rows(df, stage)
    checked.withColumn("ok", F.size("broken") == 0).write.mode("overwrite").partitionBy("ok").parquet(place)
    written = spark.read.schema(checked.withColumn("ok", F.lit(True)).schema).parquet(place)
    parts = {ok: written.filter(F.col("ok") == ok).drop("ok") for ok in (True, False)}
    examples(parts[False], most).write.mode("overwrite").parquet(f"{place}-examples")
    shown = spark.read.schema("rule string, row string").parquet(f"{place}-examples")
    out = Split(parts[True].select(*[_column(c) for c in df.columns]), parts[False], rule_counts(parts[False]), shown)
    if strict:
        counts = {r["rule"]: r["n"] for r in out.counts.collect()}  # a row for each rule
        if counts:
            raise SchemaError(stage, counts, sorted((r["rule"], r["row"]) for r in shown.collect()))  # ``most`` rows a rule
    return out


def validate_rows(df: DataFrame, stage: str, strict: bool = False, most: int = 5) -> DataFrame:
    """``df`` unchanged if no row breaks a rule, else SchemaError; strict: with the first example alone.

    For small tables: it runs ``df`` twice where rows are bad. ``split_rows`` runs it once.
    """
    checked = check_rows(df, stage)
    counts = {r["rule"]: r["n"] for r in rule_counts(checked).collect()}
    if counts:
        shown = sorted((r["rule"], r["row"]) for r in examples(checked, most).collect())
        raise SchemaError(stage, counts, shown[:1] if strict else shown)
    return df
