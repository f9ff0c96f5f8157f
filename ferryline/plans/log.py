"""Queries over change logs: windows of made-up events with results worked out by hand, and the ``events`` table as a log, with SQL
of its own for the checking engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import changelog, copying, gtid, report, routing, triggerlog
from .golden import rows

E = "file string, pos long, kind string, ts long, schema string, `table` string, query string, rows array<array<string>>"
B = "bin.000009"
ITEMS = [("shop", "items", ["id", "name"], ["id"], False), ("shop", "notes", ["id", "text"], [], False), ("shop", "lines", ["id", "item"], ["id"], True)]


def q(pos: int, query: str, ts: int = 100, file: str = B):
    return (file, pos, "query", ts, "shop", "", query, [])


def row(pos: int, kind: str, images: list, table: str = "items", ts: int = 100, file: str = B):
    return (file, pos, f"{kind}_rows", ts, "shop", table, "", images)


def xid(pos: int, ts: int = 100, file: str = B):
    return (file, pos, "xid", ts, "", "", "", [])


THREE = [q(100, "BEGIN"), row(110, "write", [["1", "a"]]), xid(120), row(130, "update", [["1", "a"], ["1", "b"]]), xid(140, 150), row(150, "delete", [["1", "b"]]), xid(160, 190)]
WINDOWS = {
    "three": THREE,
    "rolled_back": [row(10, "write", [["1", "a"]]), q(20, " rollback "), row(30, "write", [["2", "b"], ["3", "c"]]), q(40, "commit")],
    "open": [row(10, "write", [["1", "a"]]), xid(20), row(30, "write", [["2", "b"]]), row(35, "write", [["3", "b"]])],
    "unsupported": [q(10, "INSERT INTO t VALUES (1)"), row(20, "write", [["1", "a"]])],
    "ddl": [q(10, "CREATE TABLE t (id int)"), xid(20)],
    "risky": [q(10, "CREATE TABLE t (id int)"), q(20, "ALTER TABLE t DROP c")],
    "row_then_ddl": [row(10, "write", [["1", "a"]]), xid(20), q(30, "ALTER TABLE items ADD c int")],
    "ddl_then_row": [q(10, "ALTER TABLE items ADD c int"), row(20, "write", [["1", "a"]]), xid(30)],
    "keyless_delete": [row(10, "delete", [["1", "a"]], "notes"), xid(20)],
    "keyless_insert": [row(10, "write", [["1", "a"]], "notes"), row(11, "write", [["1", "a"]], "lines"), xid(20)],
    "odd_update": [row(10, "update", [["1", "a"]]), xid(20)],
    "over_files": [row(900, "write", [["1", "a"]], file="bin.000010"), xid(5, file="bin.000011"), row(4, "write", [["2", "b"]], file=B), xid(8, file=B)],
}


def keys(spark) -> DataFrame:
    return spark.createDataFrame(ITEMS, "database string, `table` string, all_columns array<string>, columns array<string>, has_foreign_keys boolean")


def opened(spark, name: str, excluded=()) -> DataFrame:
    return changelog.with_keys(changelog.sequenced(spark.createDataFrame(WINDOWS[name], E), list(excluded)), keys(spark))


def failure_query(spark, sf_dir: str) -> DataFrame:
    found = []
    for w in WINDOWS:
        events = opened(spark, w)
        found += [changelog.failures(events, ddl=ddl).select(F.lit(w).alias("window"), F.lit(ddl).alias("ddl"), "failure_type", "file", "pos", "operation", "table_name") for ddl in changelog.DDL_POLICIES]
    return copying.union_all(found)


def transaction_query(spark, sf_dir: str) -> DataFrame:
    names = ("three", "rolled_back", "open", "keyless_insert", "over_files", "risky")
    found = [changelog.transactions(opened(spark, w), ddl="apply").select(F.lit(w).alias("window"), "end_file", "end_pos", "events", "has_ddl", "has_fk", "keyless", F.array_join("keyless_tables", ",").alias("keyless_tables")) for w in names]
    return copying.union_all(found)


def mutation_query(spark, sf_dir: str) -> DataFrame:
    shown = lambda c: F.array_join(c, ",").alias(c)
    return changelog.mutations(opened(spark, "three")).select("op", "table_name", shown("key"), shown("old"), shown("new"))


def excluded_query(spark, sf_dir: str) -> DataFrame:
    return changelog.transactions(opened(spark, "keyless_insert", ["SHOP.notes"])).select("end_pos", "events", "has_fk", "keyless")


def gate_query(spark, sf_dir: str) -> DataFrame:
    """Transactions of 1, 2 and 1 events, the last late, under several limits."""
    txns = spark.createDataFrame([(1, B, 110, 1000, 1), (2, B, 120, 1000, 2), (3, B, 130, 400, 1), (4, B, 140, 0, 1)], "txn long, end_file string, end_pos long, end_ts long, events long").withColumns({"has_ddl": F.lit(False), "has_fk": F.lit(False), "keyless": F.lit(0), "keyless_tables": F.array().cast("array<string>")})
    cases = {"none": {}, "events_2": {"max_events": 2}, "events_3": {"max_events": 3}, "lag_500": {"max_lag_seconds": 500, "now": 1000}, "lag_first": {"max_lag_seconds": 500, "now": 1000, "max_events": 4}, "both": {"max_lag_seconds": 500, "now": 1000, "max_events": 1}}
    return copying.union_all([changelog.gates(txns, **c).select(F.lit(n).alias("gate"), "txn", "verdict") for n, c in cases.items()])


def too_large_query(spark, sf_dir: str) -> DataFrame:
    txns = spark.createDataFrame([(1, B, 110, 0, 5)], "txn long, end_file string, end_pos long, end_ts long, events long")
    return changelog.gates(txns, max_events=4).select("txn", "verdict")


def shape_query(spark, sf_dir: str) -> DataFrame:
    made = "txn long, events long, has_ddl boolean, has_fk boolean, keyless long, keyless_tables array<string>, verdict string"
    cases = {"mixed": [(1, 5, False, True, 2, ["a.b", "a.a"], "apply"), (2, 1, True, False, 0, [], "later")], "one": [(1, 2, False, False, 0, [], "apply")], "large": [(1, 60, False, False, 0, [], "apply"), (2, 2, False, False, 0, [], "apply")], "even": [(i, 60, False, False, 0, [], "apply") for i in range(3)]}
    found = [changelog.shape(spark.createDataFrame(v, made), max_events=4 if n == "mixed" else 0).select(F.lit(n).alias("case"), "transactions_seen", "transactions_applied", "events_seen", "max_transaction_events", "avg_transaction_events", F.array_join("keyless_tables", ",").alias("keyless_tables"), F.array_join("risk_signals", ",").alias("risk_signals"), "risk_level") for n, v in cases.items()]
    return copying.union_all(found)


APPLY_DEST = [(1, "one"), (2, "two"), (3, "three")]
APPLY_LOG = [(1, "insert", 1, "ins"), (2, "update", 1, "upd"), (3, "insert", 4, "new"), (4, "delete", 2, None), (5, "insert", 2, "again"), (6, "update", 9, "none"), (7, "delete", 3, None), (8, "update", 3, "gone"), (9, "insert", 4, "twice")]


def apply_query(policy: str):
    def run(spark, sf_dir: str) -> DataFrame:
        dest = spark.createDataFrame(APPLY_DEST, "k int, v string")
        log = spark.createDataFrame(APPLY_LOG, "seq int, op string, k int, v string").withColumn("place", F.lit(0))
        return changelog.applied(dest, ["k"], log, policy)

    return run


def conflict_query(spark, sf_dir: str) -> DataFrame:
    dest = spark.createDataFrame(APPLY_DEST, "k int, v string")
    log = spark.createDataFrame(APPLY_LOG, "seq int, op string, k int, v string").withColumn("place", F.lit(0))
    return changelog.conflicts(dest, ["k"], log).select("seq", "op", "failure_type", "k")


def moved_key_query(spark, sf_dir: str) -> DataFrame:
    """An update that moves a row to another key."""
    dest = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    events = [row(10, "update", [["1", "a"], ["7", "a2"]]), row(20, "update", [["7", "a2"], ["7", "a3"]]), xid(30)]
    opened_ = changelog.with_keys(changelog.sequenced(spark.createDataFrame(events, E)), keys(spark))
    return changelog.applied(dest, ["id"], changelog.as_rows(changelog.mutations(opened_), dest, ["id"]), "source-wins")


def classify_query(spark, sf_dir: str) -> DataFrame:
    errors = [(c, "", "insert") for c in changelog.SQL_ERRORS] + [(1205, "Lock wait timeout; table metadata lock", "DDL"), (1205, "metadata lock", "insert"), (9999, "", "insert"), (None, "Unknown column 'x'", "insert"), (None, "boom", "insert")]
    return changelog.classified(spark.createDataFrame(errors, "code int, message string, operation string"))


def report_query(values: str):
    def run(spark, sf_dir: str) -> DataFrame:
        made = spark.createDataFrame([("conflict_zero_rows", B, 140, "update", "shop.items", "UPDATE ..", "no row", "review", ["id=1"], ["id=1", "name=a"], ["id=1", "name=2024-01-02 03:04:05"], ["name:a->b", "... +2 more changes", "plain"])], "failure_type string, file string, pos long, operation string, table_name string, query string, message string, remediation string, value_sample array<string>, old_row_sample array<string>, new_row_sample array<string>, row_diff_sample array<string>")
        out = changelog.conflict_report(made, start=(B, 100), source_end=(B, 200), applied_end=(B, 120), ddl="warn", policy="fail", values=values)
        return out.select("failure_type", "start_pos", "source_end_pos", "applied_end_pos", "conflict_policy", "values_redacted", *(F.array_join(c, "|").alias(c) for c in ("value_sample", "old_row_sample", "new_row_sample", "row_diff_sample")))

    return run


SAMPLE = (["id", "", "c"], ["1", None, "x\ny"] + ["é" * 50, "5", "6", "7", "8"], ["1", "n", "x y"] + ["z"] * 7)


def sample_query(spark, sf_dir: str) -> DataFrame:
    made = spark.createDataFrame([SAMPLE], "n array<string>, a array<string>, b array<string>")
    return made.select(F.array_join(text.value_sample(F.col("n"), F.col("a")), "|").alias("values_shown"), F.array_join(text.difference_sample(F.col("n"), F.col("a"), F.col("b")), "|").alias("changes_shown"))


LOG_ROWS = [(1, "t", "INSERT", None, '{"id":5,"v":"e"}'), (2, "t", "update", '{"id":1,"v":"a"}', '{"id":1,"v":"A"}'), (3, "t", "update", '{"id":2,"v":"b"}', '{"id":8,"v":"B"}'), (4, "t", "delete", '{"id":3,"v":"c"}', None), (5, "u", "insert", None, '{"id":1}'), (6, "t", "insert", None, '{"id":1,"v":"dup"}')]


def log_rows(spark) -> DataFrame:
    return spark.createDataFrame(LOG_ROWS, "cdc_id long, table_name string, operation string, old_row_json string, new_row_json string")


def trigger_query(policy: str):
    def run(spark, sf_dir: str) -> DataFrame:
        dest = {"t": spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string"), "u": spark.createDataFrame([], "id int, w string")}
        out = triggerlog.apply_log(triggerlog.after(log_rows(spark), 0), dest, {"t": ["id"], "u": []}, policy)
        return out["t"].select(F.lit("t").alias("name"), "id", "v").unionByName(out["u"].select(F.lit("u").alias("name"), "id", F.col("w").alias("v")))

    return run


ROUTES = "shop.a = capture-triggers, shop.B=binlog,, crm.x=capture-triggers, shop.a=binlog, shop.c=capture-triggers"


def owner_query(spark, sf_dir: str) -> DataFrame:
    made = spark.createDataFrame([("shop", "A"), ("shop", "b"), ("shop", "C"), ("crm", "x"), ("crm", "y")], "database string, `table` string")
    return routing.owners(made, routing.parse(spark, ROUTES))


def stale_query(spark, sf_dir: str) -> DataFrame:
    made = [("by_pos", "f", "b.000009", 100, "2024-01-01", "b.000010", 4, "2023-01-01"), ("not_yet", "f", "b.000009", 100, "2024-01-01", "b.000009", 100, "2025-01-01"), ("by_time", "f", "", 0, "2024-01-01", "b.000009", 100, "2025-01-01"), ("no_type", " ", "b.000009", 100, "2024-01-01", "b.000010", 4, "2025-01-01"), ("older", "f", None, None, "2024-01-01", "b.1", 1, "2023-01-01")]
    r = spark.createDataFrame(made, "name string, failure string, rf string, rp long, ra string, cf string, cp long, ca string")
    return r.select("name", report.stale(F.col("rf"), F.col("rp"), F.col("ra").cast("timestamp"), F.col("failure"), F.col("cf"), F.col("cp"), F.col("ca").cast("timestamp")).alias("stale"))


def status_query(spark, sf_dir: str) -> DataFrame:
    made = spark.createDataFrame([(i, bool(i & 1), bool(i & 2), bool(i & 4), bool(i & 8)) for i in (0, 1, 3, 5, 9)], "run int, any_artifact boolean, incompatible_precheck boolean, verify_differs boolean, conflict_open boolean")
    return report.status_of(made).select("run", "status")


def rollup_query(spark, sf_dir: str) -> DataFrame:
    made = spark.createDataFrame([("a", 10, True, "2024-01-02"), ("b", 5, False, "2024-01-03"), ("c", 0, True, None)], "table string, rows_copied long, done boolean, updated_at string")
    return report.checkpoint_rollup(made)


def proposal_query(spark, sf_dir: str) -> DataFrame:
    made = spark.createDataFrame([(1, ["large_transaction_dominates", "single_transaction_window", "unheard_of"]), (2, list(report.SHAPE_PROPOSALS)), (3, [])], "run int, signals array<string>")
    return made.select("run", F.size(report.shape_proposals(F.col("signals"))).alias("n"))


def verify_proposal_query(spark, sf_dir: str) -> DataFrame:
    made = spark.createDataFrame([(1, 0, 0, 0, 0, 0, "hash"), (2, 0, 2, 0, 0, 0, "hash"), (3, 2, 2, 1, 1, 0, "sample"), (4, 1, 0, 0, 0, 1, "count")], "run int, d int, r int, n int, h int, c int, mode string")
    return made.select("run", F.size(report.verify_proposals(*(F.col(c) for c in ("d", "r", "n", "h", "c", "mode")))).alias("n"))


U = "3e11fa47-71ca-11e1-9e33-c80aa9429562"
GTIDS = [(U, 1), (U, 5), (U.upper(), 6), (U, 9), (U, 12), ("11111111-71ca-11e1-9e33-c80aa9429562", 3)]


def gtid_query(spark, sf_dir: str) -> DataFrame:
    sets = spark.createDataFrame([(f"{U.upper()}:1-4:5:9-10,\n{U}:20",)], "gtid_set string")
    return gtid.held(spark.createDataFrame(GTIDS, "source string, number long"), gtid.intervals(sets))


def gtid_other_query(spark, sf_dir: str) -> DataFrame:
    sets = spark.createDataFrame([("0-1-100,1-2-5",)], "gtid_set string")
    return gtid.held(spark.createDataFrame([("0", 100), ("0", 101), ("1", 5), ("2", 1)], "source string, number long"), gtid.intervals(sets, "mariadb"))


# ---- the events table as a log: signups insert, views and clicks update, errors delete, purchases commit


def events_log(spark, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"))
    kind = F.when(F.col("event_type") == "signup", "write_rows").when(F.col("event_type").isin("view", "click"), "update_rows").when(F.col("event_type") == "error", "delete_rows").otherwise("xid")
    new = F.array(F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    old = F.array(F.col("user_id").cast("string"), F.lit(None).cast("string"))
    images = F.when(kind == "write_rows", F.array(new)).when(kind == "update_rows", F.array(old, new)).when(kind == "delete_rows", F.array(old)).otherwise(F.array().cast("array<array<string>>"))
    return e.select(F.lit("bin.000001").alias("file"), F.col("event_id").alias("pos"), kind.alias("kind"), "ts", F.lit("app").alias("schema"), F.lit("users").alias("table"), F.lit("").alias("query"), images.alias("rows"))


def events_opened(spark, sf_dir: str) -> DataFrame:
    k = spark.createDataFrame([("app", "users", ["user_id", "seen"], ["user_id"], False)], "database string, `table` string, all_columns array<string>, columns array<string>, has_foreign_keys boolean")
    return changelog.with_keys(changelog.sequenced(events_log(spark, sf_dir)), k)


def events_transactions(spark, sf_dir: str) -> DataFrame:
    return changelog.transactions(events_opened(spark, sf_dir)).select("end_pos", "events")


def events_gates(spark, sf_dir: str) -> DataFrame:
    judged = changelog.gates(changelog.transactions(events_opened(spark, sf_dir)), max_events=100)
    return judged.groupBy("verdict").agg(F.count("*").alias("transactions"), F.sum("events").alias("events"), F.max("end_pos").alias("last_pos"))


def events_shape(spark, sf_dir: str) -> DataFrame:
    judged = changelog.gates(changelog.transactions(events_opened(spark, sf_dir)), max_events=100)
    return changelog.shape(judged, max_events=100).select("transactions_seen", "transactions_applied", "events_seen", "applied_events", "max_transaction_events", "avg_transaction_events")


def events_failure(spark, sf_dir: str) -> DataFrame:
    return changelog.failures(events_opened(spark, sf_dir)).select("failure_type", "pos")


def events_buffer(spark, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    by_events = changelog.buffer_breach(log, 300, 0).select(F.lit("events").alias("limit"), "pos", "events", "bytes")
    return by_events.unionByName(changelog.buffer_breach(log, 0, 40_000).select(F.lit("bytes").alias("limit"), "pos", "events", "bytes"))


def events_users(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").filter("user_id % 3 = 0").select("user_id").distinct().select("user_id", F.lit(-1).cast("long").alias("seen"))


def events_changes(spark, sf_dir: str) -> DataFrame:
    dest = events_users(spark, sf_dir)
    return changelog.as_rows(changelog.mutations(events_opened(spark, sf_dir)), dest, ["user_id"])


def events_applied(policy: str):
    return lambda spark, sf_dir: changelog.applied(events_users(spark, sf_dir), ["user_id"], events_changes(spark, sf_dir), policy)


def events_conflicts(spark, sf_dir: str) -> DataFrame:
    found = changelog.conflicts(events_users(spark, sf_dir), ["user_id"], events_changes(spark, sf_dir))
    return found.groupBy("op", "failure_type").agg(F.count("*").alias("n"), F.min("user_id").alias("first_user"))


def events_admitted(spark, sf_dir: str) -> DataFrame:
    return routing.admitted(events_log(spark, sf_dir), ["pos"], 250).groupBy("second").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"))


_OPS = """e AS (SELECT event_id AS pos, user_id, CASE WHEN event_type = 'signup' THEN 'insert' WHEN event_type IN ('view','click') THEN 'update' WHEN event_type = 'error' THEN 'delete' ELSE 'end' END AS op FROM events),
t AS (SELECT *, sum(CASE WHEN op = 'end' THEN 1 ELSE 0 END) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS txn, max(CASE WHEN op = 'end' THEN pos END) OVER () AS last_end FROM e),
c AS (SELECT * FROM t WHERE op <> 'end' AND pos < last_end)"""
_TXNS = _OPS + """, x AS (SELECT coalesce(txn, 0) AS txn, count(*) AS events FROM c GROUP BY 1), ends AS (SELECT coalesce(txn, 0) AS txn, pos AS end_pos FROM t WHERE op = 'end'), tx AS (SELECT end_pos, events, sum(events) OVER (ORDER BY end_pos) AS total, row_number() OVER (ORDER BY end_pos) AS rn FROM x JOIN ends USING (txn))"""
_VERDICT = _TXNS + """, stop AS (SELECT min(end_pos) AS bound FROM tx WHERE total > 100), j AS (SELECT *, CASE WHEN bound IS NULL OR end_pos < bound THEN 'apply' WHEN end_pos = bound AND rn = 1 THEN 'max_events_limit_too_low' ELSE 'later' END AS verdict FROM tx CROSS JOIN stop)"""


def _folded(insert: str) -> str:
    step = f"CASE WHEN x.op = 'insert' THEN {insert} WHEN x.op = 'update' THEN CASE WHEN a.there THEN {{'op': 'state', 'there': TRUE, 'v': x.v}} ELSE a END ELSE {{'op': 'state', 'there': FALSE, 'v': NULL::BIGINT}} END"
    return f"""WITH {_OPS}, d AS (SELECT DISTINCT user_id FROM events WHERE user_id % 3 = 0), u AS (SELECT DISTINCT user_id FROM c UNION SELECT user_id FROM d),
l AS (SELECT u.user_id, d.user_id IS NOT NULL AS there, list({{'op': c.op, 'there': TRUE, 'v': c.pos}} ORDER BY c.pos) FILTER (WHERE c.pos IS NOT NULL) AS ops FROM u LEFT JOIN d ON u.user_id = d.user_id LEFT JOIN c ON u.user_id = c.user_id GROUP BY 1, 2),
f AS (SELECT user_id, list_reduce(list_prepend({{'op': 'state', 'there': there, 'v': CASE WHEN there THEN -1::BIGINT END}}, coalesce(ops, [])), lambda a, x: {step}) AS s FROM l)
SELECT user_id, s.v AS seen FROM f WHERE s.there"""


_SIZE = "(96 + 10 + 3 + 5 + CASE WHEN event_type = 'signup' THEN 24 + length(CAST(user_id AS VARCHAR)) + length(CAST(event_id AS VARCHAR)) WHEN event_type IN ('view','click') THEN 48 + 2 * length(CAST(user_id AS VARCHAR)) + 8 + length(CAST(event_id AS VARCHAR)) WHEN event_type = 'error' THEN 24 + length(CAST(user_id AS VARCHAR)) + 8 ELSE 0 END)"

QUERIES = {
    "log_failures": failure_query, "log_transactions": transaction_query, "log_row_images": mutation_query, "log_excluded_table": excluded_query, "log_gates": gate_query, "log_first_too_large": too_large_query, "log_shape": shape_query,
    "apply_source_wins": apply_query("source-wins"), "apply_dest_wins": apply_query("dest-wins"), "apply_conflicts": conflict_query, "apply_key_change": moved_key_query, "failure_classify": classify_query, "conflict_report": report_query("redacted"), "conflict_report_plain": report_query("plain"), "value_samples": sample_query,
    "cdc_apply": trigger_query("source-wins"), "cdc_apply_dest_wins": trigger_query("dest-wins"), "cdc_page": lambda spark, sf_dir: triggerlog.after(log_rows(spark), 2, 3).select("cdc_id", "table_name"), "cdc_checkpoint": lambda spark, sf_dir: triggerlog.checkpoint(triggerlog.after(log_rows(spark), 2, 3)), "cdc_purge": lambda spark, sf_dir: triggerlog.purged(log_rows(spark), 4).select("cdc_id"),
    "routing_owner": owner_query, "routing_conflict": lambda spark, sf_dir: routing.several_owners(spark.createDataFrame([("shop", "a", "binlog"), ("shop", "a", "capture-triggers"), ("shop", "b", "binlog")], "database string, `table` string, mode string")).select("database", "table", F.array_join("modes", ",").alias("modes")),
    "routing_databases": lambda spark, sf_dir: routing.databases_of(routing.parse(spark, ROUTES), "capture-triggers", spark.createDataFrame([("zzz",)], "database string")), "report_stale": stale_query, "report_status": status_query, "checkpoint_rollup": rollup_query, "shape_proposals": proposal_query, "verify_proposals": verify_proposal_query,
    "gtid_membership": gtid_query, "gtid_membership_other": gtid_other_query, "events_transactions": events_transactions, "events_gates": events_gates, "events_shape": events_shape, "events_failure": events_failure, "events_buffer": events_buffer, "events_source_wins": events_applied("source-wins"), "events_dest_wins": events_applied("dest-wins"), "events_conflicts": events_conflicts, "events_admitted": events_admitted,
}


def _failures() -> str:
    out = []
    for ddl in changelog.DDL_POLICIES:
        out += [("open", ddl, "incomplete_transaction", B, 35, "transaction", ""), ("unsupported", ddl, "unsupported_query_event", B, 10, "query", ""), ("row_then_ddl", ddl, "ddl_window_unsafe_live_metadata", B, 10, "transaction", "shop.items"), ("keyless_delete", ddl, "unsafe_keyless_replay", "", None, "delete", "shop.notes"), ("odd_update", ddl, "replication_error", B, 10, "update", "shop.items")]
    out += [("ddl", "warn", "ddl_blocked", B, 10, "ddl", "shop"), ("risky", "warn", "ddl_blocked", B, 10, "ddl", "shop"), ("risky", "apply", "ddl_risky_blocked", B, 20, "ddl", "shop")]
    out += [("ddl_then_row", d, "ddl_window_unsafe_live_metadata", B, 20, "transaction", "shop.items") for d in ("ignore", "apply")] + [("ddl_then_row", "warn", "ddl_blocked", B, 10, "ddl", "shop")]
    return rows('"window", ddl, failure_type, file, pos BIGINT, operation, table_name', *out)


_CODES = {**changelog.SQL_ERRORS}
SQL = {
    "log_failures": _failures(),
    "log_transactions": rows('"window", end_file, end_pos BIGINT, events BIGINT, has_ddl, has_fk, keyless BIGINT, keyless_tables', ("three", B, 120, 1, False, False, 0, ""), ("three", B, 140, 1, False, False, 0, ""), ("three", B, 160, 1, False, False, 0, ""), ("rolled_back", B, 40, 2, False, False, 0, ""), ("open", B, 20, 1, False, False, 0, ""), ("keyless_insert", B, 20, 2, False, True, 1, "shop.notes"), ("over_files", "bin.000011", 5, 1, False, False, 0, ""), ("over_files", B, 8, 1, False, False, 0, ""), ("risky", B, 10, 1, True, False, 0, ""), ("risky", B, 20, 1, True, False, 0, "")),
    "log_row_images": rows('op, table_name, "key", "old", "new"', ("insert", "shop.items", "1", None, "1,a"), ("update", "shop.items", "1", "1,a", "1,b"), ("delete", "shop.items", "1", "1,b", None)),
    "log_excluded_table": rows("end_pos BIGINT, events BIGINT, has_fk, keyless BIGINT", (20, 1, True, 0)),
    "log_gates": rows("gate, txn BIGINT, verdict", *(("none", i, "apply") for i in (1, 2, 3, 4)), ("events_2", 1, "apply"), *(("events_2", i, "later") for i in (2, 3, 4)), *(("events_3", i, "apply") for i in (1, 2)), *(("events_3", i, "later") for i in (3, 4)), *((g, i, "apply") for g in ("lag_500", "lag_first") for i in (1, 2)), *((g, 3, "lag_limit_exceeded") for g in ("lag_500", "lag_first")), *((g, 4, "later") for g in ("lag_500", "lag_first")), ("both", 1, "apply"), *(("both", i, "later") for i in (2, 3, 4))),
    "log_first_too_large": rows("txn BIGINT, verdict", (1, "max_events_limit_too_low")),
    "log_shape": rows('"case", transactions_seen BIGINT, transactions_applied BIGINT, events_seen BIGINT, max_transaction_events BIGINT, avg_transaction_events BIGINT, keyless_tables, risk_signals, risk_level',
        ("mixed", 2, 1, 6, 5, 3, "a.a,a.b", "ddl_serializes_apply,foreign_key_serialization_pressure,keyless_row_matching_pressure,transaction_exceeds_max_events_limit,window_cut_before_next_transaction", "high"), ("one", 1, 1, 2, 2, 2, "", "single_transaction_window", "medium"), ("large", 2, 2, 62, 60, 31, "", "", ""), ("even", 3, 3, 180, 60, 60, "", "", "")),
    "apply_source_wins": rows("k INTEGER, v", (1, "upd"), (2, "again"), (4, "twice")),
    "apply_dest_wins": rows("k INTEGER, v", (1, "upd"), (2, "again"), (4, "new")),
    "apply_conflicts": rows("seq INTEGER, op, failure_type, k INTEGER", (1, "insert", "conflict_duplicate_key", 1), (6, "update", "conflict_zero_rows", 9), (8, "update", "conflict_zero_rows", 3), (9, "insert", "conflict_duplicate_key", 4)),
    "apply_key_change": rows("id INTEGER, name", (2, "b"), (7, "a3")),
    "failure_classify": rows("code INTEGER, message, operation, failure_type", (1062, "", "insert", "conflict_duplicate_key"), *((c, "", "insert", "conflict_foreign_key") for c in (1451, 1452)), *((c, "", "insert", "schema_drift") for c in (1054, 1136, 1146, 1051)), *((c, "", "insert", "permission_denied") for c in (1044, 1045, 1142)), *((c, "", "insert", "data_conversion_error") for c in (1366, 1406, 1265)), *((c, "", "insert", "retryable_transaction_error") for c in (1213, 1205)),
        (1205, "Lock wait timeout; table metadata lock", "DDL", "metadata_lock_timeout"), (1205, "metadata lock", "insert", "retryable_transaction_error"), (9999, "", "insert", "apply_sql_error"), (None, "Unknown column 'x'", "insert", "schema_drift"), (None, "boom", "insert", "apply_sql_error")),
    "conflict_report": rows("failure_type, start_pos BIGINT, source_end_pos BIGINT, applied_end_pos BIGINT, conflict_policy, values_redacted, value_sample, old_row_sample, new_row_sample, row_diff_sample", ("conflict_zero_rows", 100, 140, 120, "fail", True, "id=<redacted>", "id=<redacted>|name=<redacted>", "id=<redacted>|name=<redacted>", "name:<redacted>|<redacted>|<redacted>")),
    "conflict_report_plain": rows("failure_type, start_pos BIGINT, source_end_pos BIGINT, applied_end_pos BIGINT, conflict_policy, values_redacted, value_sample, old_row_sample, new_row_sample, row_diff_sample", ("conflict_zero_rows", 100, 140, 120, "fail", False, "id=1", "id=1|name=a", "id=1|name=2024-01-02 03:04:05", "name:a->b|... +2 more changes|plain")),
    "value_samples": rows("values_shown, changes_shown", ("id=1|v2=NULL|c=x y|v4=" + "é" * 40 + "...|v5=5|v6=6|... +2 more", "v2:NULL->n|v4:" + "é" * 40 + "...->z|v5:5->z|v6:6->z|v7:7->z|v8:8->z")),
    "cdc_apply": rows("name, id INTEGER, v", ("t", 1, "dup"), ("t", 5, "e"), ("t", 8, "B"), ("u", 1, None)),
    "cdc_apply_dest_wins": rows("name, id INTEGER, v", ("t", 1, "A"), ("t", 5, "e"), ("t", 8, "B"), ("u", 1, None)),
    "cdc_page": rows("cdc_id BIGINT, table_name", (3, "t"), (4, "t"), (5, "u")),
    "cdc_checkpoint": rows("last_id BIGINT, events BIGINT", (5, 3)),
    "cdc_purge": rows("cdc_id BIGINT", (5,), (6,)),
    "routing_owner": rows('"database", "table", mode', ("shop", "A", "binlog"), ("shop", "b", "binlog"), ("shop", "C", "capture-triggers"), ("crm", "x", "capture-triggers"), ("crm", "y", "binlog")),
    "routing_conflict": rows('"database", "table", modes', ("shop", "a", "binlog,capture-triggers")),
    "routing_databases": rows('"database"', ("crm",), ("shop",)),
    "report_stale": rows("name, stale", ("by_pos", True), ("not_yet", False), ("by_time", True), ("no_type", False), ("older", False)),
    "report_status": rows("run INTEGER, status", (0, "empty"), (1, "ok"), (3, "attention_required"), (5, "attention_required"), (9, "attention_required")),
    "checkpoint_rollup": rows("tables BIGINT, completed BIGINT, rows_copied BIGINT, updated_at", (3, 2, 15, "2024-01-03")),
    "shape_proposals": rows("run INTEGER, n INTEGER", (1, 1), (2, 6), (3, 0)),
    "verify_proposals": rows("run INTEGER, n INTEGER", (1, 0), (2, 1), (3, 3), (4, 1)),
    "gtid_membership": rows("source, number BIGINT, executed", (U, 1, True), (U, 5, True), (U.upper(), 6, False), (U, 9, True), (U, 12, False), (GTIDS[5][0], 3, False)),
    "gtid_membership_other": rows("source, number BIGINT, executed", ("0", 100, True), ("0", 101, False), ("1", 5, True), ("2", 1, False)),
    "events_transactions": f"WITH {_TXNS} SELECT end_pos, events FROM tx",
    "events_gates": f"WITH {_VERDICT} SELECT verdict, count(*) AS transactions, CAST(sum(events) AS BIGINT) AS events, max(end_pos) AS last_pos FROM j GROUP BY 1",
    "events_shape": f"WITH {_VERDICT} SELECT count(*) AS transactions_seen, count(*) FILTER (WHERE verdict = 'apply') AS transactions_applied, CAST(sum(events) AS BIGINT) AS events_seen, CAST(coalesce(sum(events) FILTER (WHERE verdict = 'apply'), 0) AS BIGINT) AS applied_events, max(events) AS max_transaction_events, CAST(sum(events) // count(*) AS BIGINT) AS avg_transaction_events FROM j",
    "events_failure": "SELECT 'incomplete_transaction' AS failure_type, max(event_id) FILTER (WHERE event_type <> 'purchase') AS pos FROM events HAVING max(event_id) FILTER (WHERE event_type <> 'purchase') > max(event_id) FILTER (WHERE event_type = 'purchase')",
    "events_buffer": f"WITH s AS (SELECT event_id AS pos, row_number() OVER (ORDER BY event_id) AS events, CAST(sum({_SIZE}) OVER (ORDER BY event_id) AS BIGINT) AS bytes FROM events) SELECT * FROM (SELECT 'events' AS \"limit\", pos, events, bytes FROM s WHERE events > 300 ORDER BY pos LIMIT 1) UNION ALL SELECT * FROM (SELECT 'bytes' AS \"limit\", pos, events, bytes FROM s WHERE bytes > 40000 ORDER BY pos LIMIT 1)",
    "events_source_wins": _folded("{'op': 'state', 'there': TRUE, 'v': x.v}"),
    "events_dest_wins": _folded("CASE WHEN a.there THEN a ELSE {'op': 'state', 'there': TRUE, 'v': x.v} END"),
    "events_conflicts": f"WITH {_OPS}, o AS (SELECT c.*, lag(op) OVER (PARTITION BY user_id ORDER BY pos) AS before FROM c), h AS (SELECT *, CASE WHEN before IS NULL THEN user_id % 3 = 0 ELSE before <> 'delete' END AS there FROM o) SELECT op, CASE WHEN op = 'insert' THEN 'conflict_duplicate_key' ELSE 'conflict_zero_rows' END AS failure_type, count(*) AS n, min(user_id) AS first_user FROM h WHERE (op = 'insert') = there GROUP BY 1, 2",
    "events_admitted": "SELECT (rn - 1) // 250 AS second, count(*) AS n, max(event_id) AS last_pos FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn FROM events) GROUP BY 1",
}
