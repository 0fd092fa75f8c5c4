"""Review decisions with their audit trail."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from skyledger.session import materialise

BULK_ENTITY_IDS = 50
BULK_BLOCK = 1000
AUDIT_LIMIT_MAX = 1000
RUNS_LIMIT_MAX = 500


def previous_in_group(df: DataFrame, key: str, at: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``value`` of the row before, per ``key`` in order of (``at``, ``order``).

    The order is cut into hours: inside an hour a window looks back one row, and
    the first row of an hour takes the last value of the hour before it.  So a
    key with very many rows is spread over many windows.
    """
    hour = F.date_trunc("hour", at)
    seq = [F.col(at), *[F.col(c) for c in order]]
    cut = df.withColumn("_hour", hour).withColumn("_value", value)
    inside = Window.partitionBy(key, "_hour").orderBy(*seq)
    cut = cut.withColumn("_inside", F.lag(F.struct("_value")).over(inside))
    last = cut.groupBy(key, "_hour").agg(F.max_by(F.struct("_value"), F.struct(*seq)).alias("_last"))
    across = Window.partitionBy(key).orderBy("_hour")
    before = last.select(key, "_hour", F.lag("_last").over(across).alias("_before"))
    joined = cut.join(before, [key, "_hour"])
    found = F.coalesce(F.col("_inside"), F.col("_before"))
    return joined.withColumn(name, found["_value"]).drop("_hour", "_value", "_inside", "_last", "_before")


def apply_decisions(
    reports: DataFrame, decisions: DataFrame, id_column: str = "report_id"
) -> tuple[DataFrame, DataFrame]:
    """Reports after a batch of decisions, and one audit row per decision.

    ``decisions``: id, status, note, reviewer, decided_at, decision_id.  Of
    several decisions on one report the last counts; each audit row shows the
    state just before it.  Decisions on unknown reports leave no trace.
    """
    state = F.struct(F.col("status").alias("verification_status"), F.col("note").alias("verification_note"))
    latest = decisions.groupBy(id_column).agg(
        F.max_by(F.struct("status", "note", "reviewer", "decided_at"), F.struct("decided_at", "decision_id")).alias("d")
    )
    keep = [c for c in reports.columns if c not in ("verification_status", "verification_note", "verified_by", "verified_at")]
    joined = reports.join(latest, id_column, "left")
    decided = F.col("d").isNotNull()

    def old(c: str, kind: str) -> Column:
        return F.col(c) if c in reports.columns else F.lit(None).cast(kind)

    after = joined.select(
        *keep,
        F.when(decided, F.col("d.status")).otherwise(old("verification_status", "string")).alias("verification_status"),
        F.when(decided, F.col("d.note")).otherwise(old("verification_note", "string")).alias("verification_note"),
        F.when(decided, F.col("d.reviewer")).otherwise(old("verified_by", "string")).alias("verified_by"),
        F.when(decided, F.col("d.decided_at")).otherwise(
            F.col("verified_at") if "verified_at" in reports.columns else F.lit(None)
        ).alias("verified_at"),
    )
    chained = previous_in_group(decisions, id_column, "decided_at", ["decision_id"], state, "_previous")
    stored = reports.select(id_column, F.struct("verification_status", "verification_note").alias("_stored"))
    audit = chained.join(stored, id_column).select(
        F.col("reviewer").alias("user_id"),
        F.concat(F.lit("verification:"), "status").alias("action"),
        F.lit("report").alias("entity"),
        F.col(id_column).cast("string").alias("entity_id"),
        F.to_json(F.coalesce("_previous", "_stored"), {"ignoreNullFields": "false"}).alias("before"),
        F.to_json(state, {"ignoreNullFields": "false"}).alias("after"),
        F.col("decided_at").alias("created_at"),
    )
    return after, audit


@dataclass(frozen=True, eq=False)
class Bulk:
    """What a bulk decision did: the reports after it, one row of counts, the ids that no report has, and the audit rows."""

    reports: DataFrame
    result: DataFrame
    missing: DataFrame
    audit: DataFrame


def apply_bulk(
    reports: DataFrame, ids: DataFrame, status: str, note: str | None, reviewer: str, at: dt.datetime,
    id_column: str = "report_id",
) -> Bulk:
    """One status for all given ids (distinct integer ``position``, id).

    ``result`` has updated, missing (counts), status and the first updated ids in ``entity_id``; ``missing`` is a row per unknown id.  The
    audit has one row per block of ``BULK_BLOCK`` positions, which lists the updated ids of the block in ``after`` and names its first
    ones in ``entity_id``; so ids of any number never meet in one row.
    """
    known = reports.select(id_column, F.lit(True).alias("_known"))
    marked = ids.join(known, id_column, "left").select("position", F.col(id_column).cast("string").alias("id"), F.col("_known").isNotNull().alias("found"))
    marked = materialise(marked, "bulk")
    entry = F.struct("position", "id")

    def listed(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["id"]).alias("ids"))

    first = listed(marked.filter("found").orderBy("position").limit(BULK_ENTITY_IDS))
    result = marked.agg(F.count_if("found").alias("updated"), F.count_if(~F.col("found")).alias("missing")).select(
        "updated", "missing", F.lit(status).alias("status"), F.array_join(first.select("ids").scalar(), ",").alias("entity_id")
    )
    blocks = listed(marked.filter("found").withColumn("block", F.expr(f"position div {BULK_BLOCK}")), "block")
    audit = blocks.select(
        F.lit(reviewer).alias("user_id"),
        F.lit(f"bulk_verification:{status}").alias("action"),
        F.lit("reports").alias("entity"),
        F.array_join(F.slice("ids", 1, BULK_ENTITY_IDS), ",").alias("entity_id"),
        F.lit(None).cast("string").alias("before"),
        F.to_json(F.struct("ids", F.lit(note).cast("string").alias("note")), {"ignoreNullFields": "false"}).alias("after"),
        F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz").alias("created_at"),
    )
    decisions = ids.select(
        id_column, F.lit(status).alias("status"), F.lit(note).cast("string").alias("note"), F.lit(reviewer).alias("reviewer"),
        F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz").alias("decided_at"), F.col("position").alias("decision_id"),
    )
    after, _each = apply_decisions(reports, decisions, id_column)
    return Bulk(after, result, marked.filter("NOT found").select("position", "id"), audit)


def audit_entries(audit: DataFrame, action: str | None = None, limit: int = 100) -> DataFrame:
    if not 1 <= limit <= AUDIT_LIMIT_MAX:
        raise ValueError(f"limit within 1..{AUDIT_LIMIT_MAX} expected")
    if action:
        audit = audit.filter(F.col("action") == action)
    return audit.orderBy(F.desc("created_at"), "entity_id").limit(limit)


def recent_runs(runs: DataFrame, source: str | None = None, limit: int = 50) -> DataFrame:
    if not 1 <= limit <= RUNS_LIMIT_MAX:
        raise ValueError(f"limit within 1..{RUNS_LIMIT_MAX} expected")
    if source:
        runs = runs.filter(F.col("source") == source)
    return runs.orderBy(F.desc("started_at"), "id").limit(limit)


def consumer_lag(committed: DataFrame, ends: DataFrame) -> DataFrame:
    """Lag per consumer group with the total; partitions without an end count 0.

    ``committed``: consumer_group, topic, partition_id, committed;
    ``ends``: topic, partition_id, end_offset.
    """
    behind = F.greatest(F.coalesce(F.col("end_offset") - F.col("committed"), F.lit(0)), F.lit(0))
    lag = committed.join(ends, ["topic", "partition_id"], "left").withColumn("behind", behind)
    per_group = lag.groupBy("consumer_group").agg(F.sum("behind").alias("lag"))
    return per_group.withColumn("total", F.sum("lag").over(Window.partitionBy(F.lit(1))))
