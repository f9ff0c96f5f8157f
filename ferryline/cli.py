"""The command line: ``python -m ferryline.cli [global options] <command> [options]`` over folders of Parquet (``sources.server``)."""

from __future__ import annotations

import argparse
import json
import logging
import sys
import threading
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import changelog, compat, copying, objects, prechecks, report, schema_diff, verify
from .operators.digest import Incompatible
from .sources import state
from .sources.server import Server
from .streaming.replicate import Stopped, ready

OK, USAGE, DIFFERS, FAILED, VERIFY_FAILED = 0, 1, 2, 3, 4  # exit codes
PLAIN_OBJECTS, ALL_OBJECTS = ("tables", "views"), ("tables", "views", "routines", "triggers", "events")
log = logging.getLogger("ferryline")


class Usage(ValueError):
    pass


class Differs(RuntimeError):
    """The command ran and found differences or incompatibilities."""


class Parser(argparse.ArgumentParser):
    def error(self, message):
        raise Usage(message)


def items(raw: str) -> list[str]:
    return [x.strip() for x in raw.split(",") if x.strip()]


def unsupported_objects(wanted: list[str], known=ALL_OBJECTS) -> list[str]:
    return sorted({w.lower() for w in wanted} - set(known))


def global_parser() -> Parser:
    p = Parser(prog="ferryline", description=__doc__)
    for name in ("source", "dest", "config", "databases", "include-objects", "ca-file", "cert-file", "key-file", "state-dir", "downgrade-profile"):
        p.add_argument(f"--{name}")
    p.add_argument("--exclude-databases", dest="exclude_databases")
    for name in ("concurrency", "rate-limit", "operation-timeout"):
        p.add_argument(f"--{name}", type=int)
    p.add_argument("--tls-mode", choices=("disabled", "preferred", "required"))
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--dry-run-mode", choices=("plan", "sandbox"), default="plan")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--json", action="store_true")
    p.add_argument("command", choices=tuple(COMMANDS))
    p.add_argument("rest", nargs=argparse.REMAINDER)
    return p


def settings_of(args) -> state.Settings:
    flags = {n: getattr(args, n) for n in ("source", "dest", "state_dir", "databases", "exclude_databases", "concurrency", "rate_limit", "downgrade_profile", "tls_mode")}
    return state.Settings.load(Path(args.config).read_text() if args.config else "{}", **flags).check()


def sides(spark, cfg):
    if not cfg.source or not cfg.dest:
        raise Usage("--source and --dest are required")
    return Server(spark, cfg.source), Server(spark, cfg.dest)


def compatible(spark, a: Server, b: Server, cfg):
    versions = [s.catalog().setting("version") or "" for s in (a, b)]
    pair = spark.createDataFrame([(*versions, cfg.downgrade_profile, len(items(cfg.databases)))], "source string, dest string, profile string, selected_databases int")
    return compat.evaluate(pair).first()


def plan(spark, cfg, args, rest) -> dict:
    a, b = sides(spark, cfg)
    verdict = compatible(spark, a, b, cfg)
    found = prechecks.plan(a.catalog(), b.catalog(), items(cfg.databases), items(cfg.exclude_databases)).collect()
    out = {"command": "plan", "compatible": verdict["compatible"] and all(f["severity"] != "error" for f in found), "requires_evidence": verdict["requires_evidence"], "findings": [f.asDict() for f in verdict["findings"]] + [f.asDict() for f in found]}
    fixes = [r["fix"] for r in prechecks.fix_script(a.catalog(), a.scope(items(cfg.databases), items(cfg.exclude_databases))).collect()] if any(f["code"] == "zero_date_default_column" for f in found) else []
    script = Path(cfg.state_dir) / "zero-date-fixes.sql"
    if fixes:
        state.write_private(str(script), "\n".join(fixes) + "\n")
    else:
        script.unlink(missing_ok=True)
    for name, check in (("collation-precheck", "collation"), ("plugin-lifecycle-precheck", "plugin-lifecycle"), ("invisible-gipk-precheck", "invisible-gipk")):
        state.save_artifact(cfg.state_dir, name, {"findings": [f.asDict() for f in found if f["precheck"] == check]})
    if not out["compatible"]:
        raise Differs(json.dumps(out))
    return out


def migrate(spark, cfg, args, rest) -> dict:
    p = Parser(prog="ferryline migrate")
    p.add_argument("--schema-only", action="store_true")
    p.add_argument("--data-only", action="store_true")
    p.add_argument("--chunk-size", type=int, default=cfg.chunk_rows)
    opts = p.parse_args(rest)
    if opts.schema_only and opts.data_only:
        raise Usage("--schema-only and --data-only exclude each other")
    if bad := unsupported_objects(items(args.include_objects or "tables,views")):
        raise Usage(f"unsupported objects: {', '.join(bad)}")
    a, b = sides(spark, cfg)
    with state.DirLock(cfg.state_dir):
        include, exclude = items(cfg.databases), items(cfg.exclude_databases)
        if not compatible(spark, a, b, cfg)["compatible"]:
            raise Differs("incompatible_for_version: the profile blocks this pair")
        if not opts.data_only and prechecks.incompatible(prechecks.plan(a.catalog(), b.catalog(), include, exclude, prechecks.BEFORE_SCHEMA)):
            raise Differs("incompatible_for_migrate: see plan")
        scope, out = a.scope(include, exclude), {"command": "migrate", "tables": {}, "statements": 0}
        if not opts.data_only:
            wanted = {"tables": ("table",), "views": ("view",), "routines": ("procedure", "function"), "triggers": ("trigger",), "events": ("event",)}
            types = tuple(t for o in items(args.include_objects or "tables,views") for t in wanted[o.lower()])
            rehearsal = "sandbox" if args.dry_run else None
            out["statements"] = objects.schema_statements(a.catalog(), scope, types, rehearsal).count()
        if not opts.schema_only:
            if prechecks.incompatible(prechecks.data_shape(a.catalog(), b.catalog(), include, exclude)):
                raise Differs("incompatible_for_v1_copy: tables without a stable key")
            loaded = state.load_artifact(cfg.state_dir, "data-baseline-checkpoint") or {"tables": {}}
            ledger = {n: copying.Entry(e.get("key_columns", []), [state.decode_cursor(v) for v in e["cursor"]] if e.get("cursor") else None, e.get("rows_copied", 0), e.get("done", False)) for n, e in loaded["tables"].items()}

            def save(ledger):
                state.save_artifact(cfg.state_dir, "data-baseline-checkpoint", {"tables": {n: {"key_columns": e.key_columns, "cursor": [state.encode_cursor(v) for v in e.cursor] if e.cursor else None, "rows_copied": e.rows_copied, "done": e.done, "updated_at": state.now()} for n, e in ledger.items()}})

            keys = a.keys()
            names = a.names(scope)
            if not ledger and not args.dry_run and (full := [n for n in names if not copying.is_empty(spark, b.path_of(*n))]):
                raise Differs(f"incompatible_for_copy: {'.'.join(full[0])} is not empty at the destination")
            copied = copying.copy_tables(spark, {"/".join(n): a.table(*n) for n in names}, f"{b.path}/tables", {"/".join(n): k for n, k in keys.items()}, ledger, workers=cfg.concurrency, save=(lambda _: None) if args.dry_run else save, rehearse=args.dry_run)
            out["tables"] = copied
        return out


def migrate_users(spark, cfg, args, rest) -> dict:
    p = Parser(prog="ferryline migrate-users")
    p.add_argument("--scope", choices=("business", "all"), default="business")
    opts = p.parse_args(rest)
    a, _ = sides(spark, cfg)
    business = opts.scope == "business"
    return {"command": "migrate-users", **objects.account_counts(a.catalog(), business).first().asDict(), "statements": objects.account_statements(a.catalog(), business).count()}


def replicate_options(rest: list[str]) -> argparse.Namespace:
    p = Parser(prog="ferryline replicate")
    p.add_argument("--replication-mode", default="binlog")
    p.add_argument("--start-from", default="auto")
    p.add_argument("--start-file", default="")
    p.add_argument("--start-pos", type=int, default=4)
    p.add_argument("--gtid-set", default="")
    p.add_argument("--resume", choices=("true", "false"), default="true")
    p.add_argument("--apply-ddl", default="warn")
    p.add_argument("--conflict-policy", default="fail")
    p.add_argument("--conflict-values", default="redacted")
    p.add_argument("--table-routing", default="")
    p.add_argument("--idempotent", action="store_true")
    p.add_argument("--source-server-id", type=int, default=0)
    for n in ("max-events", "max-lag-seconds"):
        p.add_argument(f"--{n}", type=int, default=0)
    o = p.parse_args(rest)
    for name, known in (("replication_mode", ("binlog", "capture-triggers", "hybrid")), ("start_from", ("auto", "binlog-file:pos", "gtid")), ("apply_ddl", changelog.DDL_POLICIES), ("conflict_policy", changelog.POLICIES), ("conflict_values", ("redacted", "plain"))):
        if getattr(o, name) not in known:
            raise Usage(f"invalid --{name.replace('_', '-')} value {getattr(o, name)!r} (expected {', '.join(known)})")
    if o.start_from == "binlog-file:pos" and o.resume == "true":
        raise Usage("--resume must be false when --start-from=binlog-file:pos")
    if o.start_from == "binlog-file:pos" and not o.start_file:
        raise Usage("--start-file is required when --start-from=binlog-file:pos")
    if (o.start_from == "gtid") != bool(o.gtid_set.strip()):
        raise Usage("--gtid-set goes with --start-from=gtid")
    name = o.start_file.strip()
    if name and (len(name) > 255 or ".." in name or not all(c.isalnum() or c in "._-" for c in name)):
        raise Usage("start-file must be a bare log file name of at most 255 characters")
    if o.start_pos < 4:
        raise Usage("start-pos must be >= 4")
    if o.source_server_id > 2**32 - 1:
        raise Usage("source-server-id must be <= 4294967295")
    if o.idempotent:
        raise Usage("--idempotent is not supported")
    return o


def replicate(spark, cfg, args, rest) -> dict:
    """One bounded window of the source's log, judged and applied to the destination's tables; the checkpoint moves past what was applied."""
    o = replicate_options(rest)
    if o.replication_mode != "binlog":
        raise Differs(f"--replication-mode={o.replication_mode} needs a trigger log; run operators.triggerlog and operators.routing over it")
    a, b = sides(spark, cfg)
    ready({n: a.catalog().setting(n) for n in ("log_bin", "binlog_format", "binlog_row_image")})
    with state.DirLock(cfg.state_dir):
        check = state.load_artifact(cfg.state_dir, "replication-checkpoint")
        asked = (o.start_file, o.start_pos) if o.start_file else None
        start = state.resume_position(None, check if o.resume == "true" else None, asked) or ("", 4)
        events = a.events()
        end = copying.watermark(events).first()
        inside = changelog.window(events, start, (end["file"], end["pos"]))
        breach = changelog.buffer_breach(inside).collect()
        columns = a.catalog().columns.groupBy("database", "table").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column"))), lambda x: x["column"]).alias("all_columns"))
        from .operators.catalog import replay_keys

        keyed = changelog.with_keys(changelog.sequenced(inside), replay_keys(a.catalog()).join(columns, ["database", "table"]))
        stop = changelog.failures(keyed, ddl=o.apply_ddl)
        judged = changelog.gates(changelog.transactions(keyed, ddl=o.apply_ddl), max_events=o.max_events, max_lag_seconds=o.max_lag_seconds, now=F.unix_timestamp())
        failed = breach or stop.collect() or judged.filter("verdict not in ('apply', 'later')").select(F.col("verdict").alias("failure_type"), F.col("end_file").alias("file"), F.col("end_pos").alias("pos")).collect()
        if failed:
            state.save_artifact(cfg.state_dir, "replication-conflict-report", failed[0].asDict() | {"applied_end_file": start[0], "applied_end_pos": start[1], "generated_at": state.now(), "values_redacted": True})
            raise Differs(failed[0]["failure_type"])
        done = judged.filter("verdict = 'apply'")
        last = done.agg(F.max_by(F.struct("end_file", "end_pos"), "txn").alias("l"), F.sum("events").alias("n"), F.max("txn").alias("txn")).first()
        if last["l"] is None:
            return {"command": "replicate", "applied_events": 0}
        ends = keyed.filter((F.col("mark") == "commit") & (F.col("seq") <= last["txn"])).select("txn")
        changes = changelog.mutations(keyed).join(ends, "txn", "left_semi")
        for name in [r["table_name"] for r in changes.select("table_name").distinct().collect()]:
            database, table = name.split(".", 1)
            keys, path = a.keys().get((database, table), []), b.path_of(database, table)
            dest = b.table(database, table)
            rows = changelog.as_rows(changes.filter(F.col("table_name") == name), dest, keys)
            if o.conflict_policy == "fail" and (c := changelog.conflicts(dest, keys, rows).limit(1).collect()):
                state.save_artifact(cfg.state_dir, "replication-conflict-report", {"failure_type": c[0]["failure_type"], "table_name": name, "applied_end_file": start[0], "applied_end_pos": start[1], "generated_at": state.now(), "values_redacted": True})
                raise Differs(c[0]["failure_type"])
            from .operators.tables import cut

            cut(changelog.applied(dest, keys, rows, o.conflict_policy)).write.mode("overwrite").parquet(path)
        state.save_artifact(cfg.state_dir, "replication-checkpoint", {"binlog_file": last["l"]["end_file"], "binlog_pos": last["l"]["end_pos"], "apply_ddl": o.apply_ddl, "updated_at": state.now(), "shape": changelog.shape(judged, max_events=o.max_events).first().asDict()})
        state.drop_artifact(cfg.state_dir, "replication-conflict-report")
        return {"command": "replicate", "applied_events": last["n"], "end_file": last["l"]["end_file"], "end_pos": last["l"]["end_pos"]}


def verify_command(spark, cfg, args, rest) -> dict:
    p = Parser(prog="ferryline verify")
    p.add_argument("--verify-level", choices=("data", "schema"), default="data")
    p.add_argument("--data-mode", choices=("count", "hash", "sample", "full-hash"), default="count")
    p.add_argument("--sample-size", type=int, default=1000)
    p.add_argument("--granular", action="store_true")
    o = p.parse_args(rest)
    a, b = sides(spark, cfg)
    include, exclude = items(cfg.databases), items(cfg.exclude_databases)
    if o.verify_level == "schema":
        both = a.scope(include, exclude).union(b.scope(include, exclude)).distinct()
        from .operators.catalog import within

        found = schema_diff.part_differences(a.catalog(), b.catalog()) if o.granular else schema_diff.object_differences(within(a.catalog().objects, both), within(b.catalog().objects, both))
        diffs, risky = [r.asDict() for r in found.collect()], 0
    else:
        rows = [{n: s.table(*n) for n in s.names(s.scope(include, exclude))} for s in (a, b)]
        risks = verify.table_risks(a.catalog().columns.select("database", "table", "data_type", "collation"))
        options = {"sample": o.sample_size} if o.data_mode == "sample" else {}
        diffs = [r.asDict() for r in verify.verify(spark, *rows, o.data_mode, keys=a.keys(), risks=risks, **options).collect()]
        risky = risks.count()
        state.save_artifact(cfg.state_dir, "verify-data-report", {"data_mode": o.data_mode, "summary": {"diffs": diffs, "representation_risk_tables": risky}})
    out = {"command": "verify", "level": o.verify_level, "diffs": diffs, "representation_risk_tables": risky}
    if diffs:
        raise Differs(json.dumps(out))
    return out


def report_command(spark, cfg, args, rest) -> dict:
    p = Parser(prog="ferryline report")
    p.add_argument("--include-sensitive-artifacts", action="store_true")
    p.add_argument("--fail-on-conflict", choices=("true", "false"), default="true")
    o = p.parse_args(rest)
    out = report.summary(spark, cfg.state_dir, o.include_sensitive_artifacts)
    if out["status"] == "attention_required" and o.fail_on_conflict == "true":
        raise Differs(report.as_json(out))
    return out


COMMANDS = {"plan": plan, "migrate": migrate, "migrate-users": migrate_users, "replicate": replicate, "verify": verify_command, "report": report_command}


def main(argv: list[str], spark: SparkSession | None = None, out=sys.stdout) -> int:
    command = ""
    try:
        args = global_parser().parse_args(argv)
        command, cfg = args.command, settings_of(args)
        logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
        spark = spark or SparkSession.builder.appName("ferryline").getOrCreate()
        spark.sparkContext.setJobGroup("ferryline", command, True)
        timer = threading.Timer(args.operation_timeout, lambda: spark.sparkContext.cancelJobGroup("ferryline")) if args.operation_timeout else None
        if timer:
            timer.start()
        try:
            found = COMMANDS[command](spark, cfg, args, args.rest)
        finally:
            if timer:
                timer.cancel()
        out.write(json.dumps(found, default=str, sort_keys=True) + "\n" if args.json or command != "report" else report.as_text(found))
        return OK
    except (Usage, json.JSONDecodeError, FileNotFoundError) as e:
        out.write(f"{e}\n")
        return USAGE
    except (Differs, Incompatible, Stopped) as e:
        out.write(f"{e}\n")
        return DIFFERS
    except ValueError as e:
        out.write(f"{e}\n")
        return DIFFERS if "incompatible_for_" in str(e) else USAGE
    except Exception as e:  # noqa: BLE001  the last stop: every other failure has an exit code
        log.error("%s failed: %s", command, e)
        out.write(f"{e}\n")
        return VERIFY_FAILED if command == "verify" else FAILED


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
