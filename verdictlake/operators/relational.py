"""Session-scoped relational operators: latest per key, guarded lookups, summaries, traceability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], value: Column, order: list[str], name: str) -> DataFrame:
    """The value of each key's last row in an order that must tell rows apart. An aggregate with partial maxima, so a hot key costs no sort and no task of its own."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(name))


def session_list(sessions: DataFrame, children: DataFrame, key: str, child_key: str, source: Column, order: list[str]) -> DataFrame:
    """Every session with its latest child's source, 'none' without a child. The left join's other side is broadcast by Spark if it is small."""
    latest = latest_per_key(children, [child_key], source, order, "bdd_status")
    return sessions.join(latest, sessions[key] == latest[child_key], "left").drop(latest[child_key]).withColumn("bdd_status", F.coalesce("bdd_status", F.lit("none")))


def access_code(sessions: DataFrame, wanted: DataFrame, key: str, owner: str) -> DataFrame:
    """For (session, user) pairs: 404 if the session doesn't exist, 403 if it is another user's, else 200."""
    s = sessions.select(F.col(key).alias("_key"), F.col(owner).alias("_owner"))
    return wanted.join(s, wanted["session_id"] == F.col("_key"), "left").select("session_id", "user_id", F.when(F.col("_key").isNull(), 404).when(~F.col("_owner").eqNullSafe(F.col("user_id")), 403).otherwise(200).cast("bigint").alias("code"))


def owned(df: DataFrame, owner: str, user) -> DataFrame:
    """Row-level security: every session-scoped view starts with this filter."""
    return df.filter(F.col(owner) == F.lit(user))


def create_if_absent(existing: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows to append for keys that don't exist yet."""
    return wanted.join(existing.select(key), key, "left_anti")


def summary(results: DataFrame, by: list[str], status: Column, expected: Column | None = None) -> DataFrame:
    """total, passed, failed. Of stored rows total counts rows; of parsed scenarios (`expected`) also those without a verdict."""
    failed = (status == "fail") if expected is None else status.isNotNull() & (status != "pass")
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(status == "pass").alias("passed"), F.count_if(failed).alias("failed"))


def traceability(clauses: DataFrame, scenarios: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Clause, scenario, verdict by left joins; scenarios meet verdicts by title, as ids change with every parse."""
    return clauses.join(scenarios, "source_ac_clause", "left").join(verdicts, "scenario_title", "left")


def upsert(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write wins by key: the row with the highest order value."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last")).select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest if c != order))
