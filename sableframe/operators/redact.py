"""A policy for a table's columns, compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masking import ACTIONS, redacted
from .profile import ColumnProfile


@dataclass(frozen=True)
class Rule:
    column: str
    action: str
    entity_type: str = "CUSTOM"
    enabled: bool = True
    params: dict[str, str] = field(default_factory=dict, hash=False)


def default_policy(profiles: list[ColumnProfile]) -> list[Rule]:
    return [Rule(p.name, p.action, p.entity_type, p.action != "keep") for p in profiles]


def check_policy(columns: list[str], policy: list[Rule]) -> None:
    """Duplicate, unknown and missing columns and unknown actions are errors."""
    names = [r.column for r in policy]
    faults = {
        "duplicate": sorted({n for n in names if names.count(n) > 1}),
        "unknown": sorted(set(names) - set(columns)),
        "missing": sorted(set(columns) - set(names)),
        "actions": sorted({r.action for r in policy} - set(ACTIONS)),
    }
    if any(faults.values()):
        raise ValueError("; ".join(f"{k}: {', '.join(v)}" for k, v in faults.items() if v))


def redact(df: DataFrame, policy: list[Rule], owner: str, dataset: str, secret: str) -> DataFrame:
    """Enabled columns under their action, the others and the order as they are: one projection, no Python."""
    rules = {r.column: r for r in policy if r.enabled}
    return df.select(
        *(
            redacted(F.col(c), r.action, r.entity_type, f"{owner}:{dataset}:{c}", secret, r.params).alias(c) if (r := rules.get(c)) and r.action != "keep" else F.col(c)
            for c in df.columns
        )
    )


def preview(df: DataFrame, policy: list[Rule], owner: str, dataset: str, secret: str, rows: int = 100) -> DataFrame:
    """The first rows, before and after."""
    some = df.limit(min(rows, 100))
    both = some.select(F.struct(*some.columns).alias("original"), *some.columns)
    after = redact(both, [r for r in policy if r.column != "original"], owner, dataset, secret)
    return after.select("original", F.struct(*some.columns).alias("redacted"))


def action_counts(policy: list[Rule]) -> dict[str, int]:
    out: dict[str, int] = {}
    for r in policy:
        action = r.action if r.enabled else "keep"
        out[action] = out.get(action, 0) + 1
    return out


def still_there(original: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) of originals that a redacted table still shows: the invariant is that there are none."""

    def values(df: DataFrame) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
        return df.select(F.explode(pairs).alias("p")).select("p.*").where("value IS NOT NULL AND trim(value) != ''").distinct()

    return values(original).join(values(after), ["column", "value"], "left_semi")
