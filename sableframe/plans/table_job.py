"""A table from file to delivery: read, profile, policy, redact, verify, write."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from ..operators import profile as p
from ..operators import redact as r
from ..sources import files, sinks

PROFILE_ROWS = 500


def prepare(df: DataFrame) -> tuple[list[p.ColumnProfile], list[r.Rule]]:
    """Profiles and the default policy from the first rows of a table, in its own order of columns."""
    some = df.limit(PROFILE_ROWS)
    profiles = p.profile(some, some.columns)
    return profiles, r.default_policy(profiles)


def run(spark: SparkSession, path: str, out: str, owner: str, secret: str, policy: list[r.Rule] | None = None, table: str | None = None) -> dict:
    """Read, redact and write a table; the summary says what was done."""
    df = files.read(spark, path, table)
    profiles, default = prepare(df)
    use = policy or default
    r.check_policy(df.columns, use)
    after = r.redact(df, use, owner, path.rsplit("/", 1)[-1], secret)
    summary = sinks.write_csv(after, out)
    return summary | {"actions": r.action_counts(use), "profiles": [asdict(x) for x in profiles]}
