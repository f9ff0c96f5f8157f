"""What a state folder tells: a status, a summary of its artifacts, and what to do next.

``status_of`` works on frames, one row for each state folder, so many runs are told at once; ``summary`` reads one folder.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources import state

PRESENT = ("collation-precheck", "plugin-lifecycle-precheck", "invisible-gipk-precheck", "verify-data-report", "data-baseline-checkpoint", "replication-checkpoint", "replication-conflict-report")

# What each signal of transaction shape asks for.
SHAPE_PROPOSALS = {
    "large_transaction_dominates": "reduce source transaction size or chunk bulk changes; worker count will not split one huge commit.",
    "single_transaction_window": "reduce source transaction size or chunk bulk changes; worker count will not split one huge commit.",
    "transaction_exceeds_max_events_limit": "increase --max-events or, preferably, reduce source transaction size so replication windows can advance cleanly.",
    "ddl_serializes_apply": "keep replication DDL outside hot catch-up windows or apply schema changes separately with migrate --schema-only.",
    "foreign_key_serialization_pressure": "review FK-heavy workloads and keep commit batches smaller so replica-style serialization pressure stays bounded.",
    "keyless_row_matching_pressure": "add stable primary keys where possible; fallback row matching increases apply cost and drift risk.",
    "window_cut_before_next_transaction": "expect checkpoint progress only at transaction boundaries; if windows look stalled, inspect transaction shape before tuning worker counts.",
}


def stale(report_file: Column, report_pos: Column, report_at: Column, failure: Column, file: Column, pos: Column, at: Column) -> Column:
    """Has a checkpoint left a conflict report behind?  By position where both tell one, else by time."""
    told = lambda f, p: (F.trim(F.coalesce(f, F.lit(""))) != "") & (F.coalesce(p, F.lit(0)) > 0)
    passed = text.position(file, pos) > text.position(report_file, report_pos)
    later = F.coalesce(at > report_at, F.lit(False))
    return F.when(F.trim(F.coalesce(failure, F.lit(""))) == "", False).otherwise(F.when(told(report_file, report_pos) & told(file, pos), passed).otherwise(later))


def status_of(runs: DataFrame) -> DataFrame:
    """(.., status) for rows with booleans ``any_artifact``, ``incompatible_precheck``, ``verify_differs``, ``conflict_open``."""
    attention = F.col("incompatible_precheck") | F.col("verify_differs") | F.col("conflict_open")
    return runs.withColumn("status", F.when(~F.col("any_artifact"), "empty").when(attention, "attention_required").otherwise("ok"))


def checkpoint_rollup(entries: DataFrame) -> DataFrame:
    """(tables, completed, rows_copied, updated_at) of a copy's ledger (table, rows_copied, done, updated_at)."""
    return entries.agg(F.count("*").alias("tables"), F.count_if("done").alias("completed"), F.coalesce(F.sum("rows_copied"), F.lit(0)).alias("rows_copied"), F.max("updated_at").alias("updated_at"))


def without_samples(reports: DataFrame, include_sensitive: bool = False) -> DataFrame:
    """Conflict reports as they may be shown: samples that were not redacted go, unless asked for."""
    if include_sensitive:
        return reports
    samples = [c for c in ("value_sample", "old_row_sample", "new_row_sample", "row_diff_sample") if c in reports.columns]
    held = F.greatest(*(F.size(c) > 0 for c in samples), F.lit(False))
    bare = ~F.col("values_redacted") & held
    return reports.withColumns({c: F.when(bare, F.array().cast("array<string>")).otherwise(F.col(c)) for c in samples} | {"values_redacted": F.col("values_redacted") | held})


def shape_proposals(signals: Column) -> Column:
    """Proposals for risk signals, each once, in the order of the signals."""
    known = F.create_map(*(F.lit(x) for pair in SHAPE_PROPOSALS.items() for x in pair))
    return F.array_distinct(F.filter(F.transform(signals, lambda s: known[s]), lambda p: p.isNotNull()))


def verify_proposals(differences: Column, risk_tables: Column, noisy: Column, hash_mismatches: Column, count_mismatches: Column, mode: Column) -> Column:
    clean = F.when(risk_tables > 0, F.lit("verify passed, but representation-sensitive tables exist; keep the verify artifact as evidence and review table-risk notes before treating hash modes as byte-for-byte guarantees."))
    differs = F.array(
        F.when(noisy > 0, F.lit("some verify mismatches touch representation-sensitive tables; review row samples before declaring real drift.")),
        F.when((mode == "sample") & (hash_mismatches > 0), F.lit("sample mode found drift; rerun with --data-mode=full-hash or inspect row samples before cutover decisions.")),
        F.when((hash_mismatches > 0) | (count_mismatches > 0), F.lit("treat verify mismatches as blocking until row samples or a stronger verify mode confirms whether the drift is real.")),
    )
    return F.array_compact(F.when(differences == 0, F.array(clean)).otherwise(differs))


def summary(spark: SparkSession, folder: str, include_sensitive: bool = False) -> dict:
    """The report on one state folder: status, artifacts there, roll-up of the copy, proposals."""
    found = {n: state.load_artifact(folder, n) for n in PRESENT}
    errors = [n for n in PRESENT[:3] if found[n] and any(x.get("severity") == "error" for x in found[n]["findings"])]
    conflict, check, verify = found["replication-conflict-report"], found["replication-checkpoint"], found["verify-data-report"]
    left = False
    if conflict and check:
        one = spark.range(1).select(stale(F.lit(conflict["applied_end_file"]), F.lit(conflict["applied_end_pos"]), F.lit(conflict["generated_at"] or None).cast("timestamp"), F.lit(conflict["failure_type"]), F.lit(check["binlog_file"]), F.lit(check["binlog_pos"]), F.lit(check["updated_at"] or None).cast("timestamp")).alias("s"))
        left = bool(one.first()["s"])
    differs = bool(verify and verify["summary"].get("diffs"))
    runs = spark.createDataFrame([(any(found.values()), bool(errors), differs, bool(conflict and conflict["failure_type"]) and not left)], "any_artifact boolean, incompatible_precheck boolean, verify_differs boolean, conflict_open boolean")
    ledger = [(t, int(e.get("rows_copied", 0)), bool(e.get("done")), e.get("updated_at")) for t, e in (found["data-baseline-checkpoint"] or {"tables": {}})["tables"].items()]
    rollup = checkpoint_rollup(spark.createDataFrame(ledger, "table string, rows_copied long, done boolean, updated_at string")).first().asDict()
    if conflict and not include_sensitive and not conflict["values_redacted"]:
        conflict = conflict | {k: [] for k in conflict if k.endswith("_sample")} | {"values_redacted": True}
    signals = ((conflict or {}).get("shape") or (check or {}).get("shape") or {}).get("risk_signals", [])
    proposals = list(dict.fromkeys(SHAPE_PROPOSALS[s] for s in signals if s in SHAPE_PROPOSALS))
    return {"command": "report", "status": status_of(runs).first()["status"], "artifacts": sorted(n for n, d in found.items() if d), "incompatible_prechecks": errors, "stale_conflict": left, "conflict": conflict, "baseline": rollup, "proposals": proposals}


def as_text(report: dict) -> str:
    lines = [f"status: {report['status']}", f"artifacts: {', '.join(report['artifacts']) or 'none'}", "baseline: " + ", ".join(f"{k}={v}" for k, v in report["baseline"].items())]
    if report["conflict"]:
        lines.append(f"conflict: {report['conflict']['failure_type']}" + (" (stale)" if report["stale_conflict"] else ""))
    return "\n".join([*lines, *(f"- {p}" for p in report["proposals"])]) + "\n"


def as_json(report: dict) -> str:
    return json.dumps(report, indent=2, sort_keys=True, default=str) + "\n"
