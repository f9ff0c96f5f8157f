import datetime as dt
import io
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ferryline import cli
from ferryline.operators import changelog, copying, digest, graph, objects, ordering, prechecks, routing, triggerlog, verify
from ferryline.operators.catalog import Catalog
from ferryline.plans import checks
from ferryline.sources import connection, state
from ferryline.streaming import replicate


def test_state(tmp_path):
    p = str(tmp_path / "d" / "x.json")
    state.write_private(p, "1")
    state.write_private(p, "2")
    assert open(p).read() == "2"
    with state.DirLock(str(tmp_path)), pytest.raises(RuntimeError), state.DirLock(str(tmp_path)):
        pass
    assert state.Settings.load('{"source": "a"}', source="b").source == "b"
    assert state.Settings.load("source: mysql://h/x\nconcurrency: 2  # two\n").concurrency == 2
    for bad in ('{"sauce": 1}', '{"source": "a"} trailing', "source a"):
        with pytest.raises(ValueError):
            state.Settings.load(bad)
    with pytest.raises(ValueError):
        state.Settings.load("{}", conflict_policy="maybe").check()
    assert state.redact_url("mysql://u:p@h/x") == "mysql://u:<redacted>@h/x"
    assert state.redact_pair("created_at=2024-01-02 03:04:05") == "created_at=<redacted>"


def test_artifacts_and_cursors(tmp_path):
    folder = str(tmp_path)
    assert state.load_artifact(folder, "replication-checkpoint") is None
    state.save_artifact(folder, "replication-checkpoint", {"binlog_file": "b.1", "binlog_pos": 2})
    assert state.load_artifact(folder, "replication-checkpoint")["apply_ddl"] == "warn"
    state.drop_artifact(folder, "replication-checkpoint")
    with pytest.raises(ValueError):
        state.artifact_path(folder, "other")
    values = [None, b"\x00\xff", True, False, -5, 2**63, 1.5, 1e300, "é", dt.datetime(2024, 1, 2, 3, 4, 5, 6), dt.date(2024, 1, 2), Decimal("1.50")]
    assert [state.decode_cursor(json.loads(json.dumps(state.encode_cursor(v)))) for v in values] == values
    assert state.encode_cursor(2**63)["type"] == "uint64" and state.encode_cursor(5)["type"] == "int64"
    with pytest.raises(TypeError):
        state.encode_cursor(object())
    state.write_private(str(state.artifact_path(folder, "data-baseline-checkpoint")), json.dumps({"tables": {"t": {"last_key": ["7"]}}}))
    assert state.load_artifact(folder, "data-baseline-checkpoint")["tables"]["t"]["cursor"] == [{"type": "string", "value": "7"}]
    one = state.server_id(folder)
    assert state.server_id(folder) == one and state.server_id(folder, 7) == 7 and state.server_id(folder) == one
    check = {"binlog_file": "b.2", "binlog_pos": 1}
    assert state.resume_position(check, {"binlog_file": "b.1", "binlog_pos": 9}, ("b.0", 5)) == ("b.2", 4)
    assert state.resume_position(None, None, ("b.0", 1)) == ("b.0", 4) and state.resume_position(None, None, None) is None


def test_connections(tmp_path):
    t = connection.Target.parse("mariadb://u%40x:p%3As@db.example/shop?tls=preferred&b=1&a=2")
    assert (t.user, t.password, t.port, t.database, t.tls) == ("u@x", "p:s", 3306, "shop", "preferred")
    assert t.normal() == "u@x:p:s@tcp(db.example:3306)/shop?a=2&b=1&tls=preferred"
    assert connection.Target.parse("u:p@tcp(h:1)/d").normal() == "u:p@tcp(h:1)/d"
    assert connection.Target.parse("mysql://[::1]/d").normal() == "tcp([::1]:3306)/d"
    for bad in ("", "postgres://h/x", "mysql:///x", "nonsense"):
        with pytest.raises(ValueError):
            connection.Target.parse(bad)
    assert connection.redacted("mysql://u:p@s@h/x") == "mysql://u:***@h/x" and connection.redacted("u:p@tcp(h:1)/d") == "u:***@tcp(h:1)/d" and connection.redacted("u@tcp(h:1)/d") == "u@tcp(h:1)/d" and connection.redacted("none") == "none"
    assert connection.with_tls(t, "required").tls == "true" and connection.with_tls(t, "disabled").tls == "false"
    ca = tmp_path / "ca"
    ca.write_text("no certificate")
    for mode, files in (("disabled", {"ca_file": "x"}), ("often", {}), ("required", {"cert_file": "x"}), ("required", {"ca_file": str(ca)})):
        with pytest.raises(ValueError):
            connection.with_tls(t, mode, **files)
    assert connection.log_client(t, 0)["flavor"] == "mariadb" and connection.with_tls(t, "disabled").jdbc()["sslMode"] == "DISABLED" and t.tls == "preferred"
    with pytest.raises(ValueError):
        connection.log_client(connection.Target.parse("u@unix(/tmp/s)/d"), 1)
    with pytest.raises(OSError):
        connection.ping(connection.Target("127.0.0.1", 1), 0.2)


def test_change_log_between_snapshots(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, "w")], "k long, v string")
    assert {(r.k, r.operation) for r in state.changes_between(a, b, ["k"]).collect()} == {(2, "update"), (3, "delete"), (4, "insert")}


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_numbers_and_sums_by_ranges(spark, ranges):
    df = spark.range(200).select(((F.col("id") * 37) % 200).alias("k"), (F.col("id") % 7).alias("v"))
    got = sorted((r.k, r.n, r.s) for r in ordering.running(df, ["k"], {"n": F.lit(1), "s": F.col("v")}, ranges).collect())
    value = {r.k: r.v for r in df.collect()}
    assert got == [(k, k + 1, sum(value[i] for i in range(k + 1))) for k in range(200)]
    assert ordering.numbered(df.limit(0), ["k"]).count() == 0


def test_digests(spark):
    df = spark.createDataFrame([(i, f"v<{i}>") for i in range(25)], "id int, v string")
    one = lambda d, **k: digest.table_digest(d, ["id"], k.pop("mode", "hash"), **k).first()
    assert one(df, ranges=1) == one(df.repartition(7), ranges=9)  # neither partitions nor ranges matter
    assert one(df, chunk=10)["chunks"] == 3 and one(df, chunk=10)["digest"] != one(df)["digest"]
    assert one(df.limit(0))["rows"] == 0 and one(df, mode="sample", sample=5) == one(df.filter("id < 5"), mode="sample")
    assert digest.table_digest(df.select(), [], "hash").first()["digest"] == digest.NOTHING
    for mode, word in (("hash", "deterministic_hash"), ("sample", "sample")):
        with pytest.raises(digest.Incompatible, match=f"incompatible_for_v1_{word}"):
            digest.table_digest(df, [], mode, name="a.b")
    with pytest.raises(digest.Incompatible):
        verify.verify(spark, {("a", "b"): df}, {}, "hash")
    assert verify.verify(spark, {("a", "b"): df}, {("a", "b"): df.repartition(3)}, "full-hash", keys={("a", "b"): ["id"]}).count() == 0
    plan = ordering.numbered(df, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_range" in plan  # rows are numbered inside ranges, not over the whole table


def test_replication_is_bounded_and_repeatable(spark, tmp_path):
    log, target, ck = (str(tmp_path / x) for x in ("log", "target", "ck"))
    write = lambda rows: spark.createDataFrame(rows, replicate.SCHEMA).write.mode("append").parquet(log)
    write([(1, "insert", 1, "a"), (2, "insert", 2, "b"), (3, "update", 1, "c")])
    assert {tuple(r) for r in replicate.run(spark, log, target, ck).collect()} == {(1, "c"), (2, "b")}
    assert replicate.run(spark, log, target, ck).count() == 2
    write([(4, "delete", 2, None), (5, "insert", 3, None)])
    assert {tuple(r) for r in replicate.run(spark, log, target, ck).collect()} == {(1, "c"), (3, None)}
    assert len([p for p in (tmp_path / "target").iterdir() if p.name.startswith("batch-")]) == 2
    write([(3, "insert", 9, "late")])
    with pytest.raises(Exception, match="comes after position 5"):
        replicate.run(spark, log, target, ck)
    assert replicate.read(spark, target).count() == 2
    with pytest.raises(replicate.Stopped):
        replicate.ready({"log_bin": "ON", "binlog_format": "MIXED", "binlog_row_image": "FULL"})


def test_replication_policies(spark, tmp_path):
    changes = [(1, "insert", 1, "a"), (2, "insert", 1, "b")]
    for policy, want in (("source-wins", "b"), ("dest-wins", "a")):
        log = str(tmp_path / policy)
        spark.createDataFrame(changes, replicate.SCHEMA).write.parquet(log)
        assert replicate.run(spark, log, f"{log}-t", f"{log}-c", policy=policy).first()["v"] == want
    log = str(tmp_path / "fail")
    spark.createDataFrame(changes, replicate.SCHEMA).write.parquet(log)
    with pytest.raises(Exception, match="conflict_duplicate_key at 2"):
        replicate.run(spark, log, f"{log}-t", f"{log}-c", policy="fail")
    assert replicate.read(spark, f"{log}-t").count() == 0


def test_folds_agree_with_one_change_at_a_time(spark):
    import random

    rng = random.Random(7)
    for policy in ("source-wins", "dest-wins"):
        start = {k: f"s{k}" for k in range(0, 12, 2)}
        log = [(i, rng.choice(["insert", "update", "delete"]), rng.randrange(12), f"v{i}") for i in range(150)]
        want = dict(start)
        for _, op, k, v in log:
            if op == "delete":
                want.pop(k, None)
            elif op == "update" and k in want or op == "insert" and (policy == "source-wins" or k not in want):
                want[k] = v
        dest = spark.createDataFrame(list(start.items()), "k int, v string")
        changes = spark.createDataFrame(log, "seq int, op string, k int, v string").withColumn("place", F.lit(0))
        assert {r.k: r.v for r in changelog.applied(dest, ["k"], changes, policy).collect()} == want


def test_log_events_are_typed(spark):
    raw = spark.createDataFrame([("QueryEvent", "f", 1), ("XID_EVENT", "f", 2), ("WRITE_ROWS_EVENTv2", "f", 3), ("ROTATE_EVENT", "f", 4)], "event_type string, file string, pos long").withColumns({"ts": F.lit(0), "schema": F.lit("s"), "table": F.lit("t"), "query": F.lit(""), "rows": F.array().cast("array<array<string>>")})
    assert [r.kind for r in changelog.typed(raw).orderBy("pos").collect()] == ["query", "xid", "write_rows"]
    inside = changelog.window(changelog.typed(raw), ("f", 1), ("f", 3))
    assert [r.pos for r in inside.orderBy("pos").collect()] == [2, 3]
    with pytest.raises(ValueError):
        changelog.failures(raw, ddl="sometimes")


def test_copies_resume(spark, tmp_path):
    src = spark.range(100).selectExpr("id div 10 as a", "id % 10 as b", "id as v")
    first = copying.page(src, ["a", "b"], rows=30)
    path = str(tmp_path / "dest")
    first.write.parquet(path)
    assert copying.cursor_of(first, ["a", "b"]) == (2, 9) and not copying.is_empty(spark, path) and copying.is_empty(spark, path + "x")
    assert copying.resume(src, path, ["a", "b"]) == 70 and spark.read.parquet(path).distinct().count() == 100
    assert copying.resume(src, path, ["a", "b"]) == 0 and copying.resume(src, path + "2", ["a", "b"]) == 100


def test_ledger_of_copies(spark, tmp_path):
    tables = {"a": spark.range(20), "b": spark.range(5).selectExpr("id as k", "id as v")}
    ledger, saved = {}, []
    run = lambda **k: copying.copy_tables(spark, tables, str(tmp_path), {"a": ["id"], "b": ["k"]}, ledger, order=["b", "a"], save=lambda x: saved.append(copying.ledger_text(x)), **k)
    assert copying.copy_tables(spark, tables, str(tmp_path), {"a": ["id"], "b": ["k"]}, {}, rehearse=True) == {"a": 20, "b": 5} and not list(tmp_path.glob("[!.]*"))
    assert run() == {"a": 20, "b": 5} and run() == {"a": 0, "b": 0} and ledger["a"].cursor == [19] and len(saved) == 4
    ledger["a"].done = False
    assert run(workers=1)["a"] == 0 and spark.read.parquet(str(tmp_path / "a")).count() == 20
    with pytest.raises(digest.Incompatible, match="incompatible_for_v1_copy"):
        copying.copy_tables(spark, tables, str(tmp_path), {"a": ["id"]}, {})
    e = copying.Entry
    assert copying.resume_point(None, ["k"], None) == ("start", None) and copying.resume_point(e(done=True), ["k"], None) == ("skip", None)
    assert copying.resume_point(e(["k"], [5]), ["k"], (9,)) == ("from", (5,)) and copying.resume_point(e(["j"], [5], 3), ["k"], (9,)) == ("from", (9,))
    assert copying.resume_point(e(["k"], [5, 6], 0), ["k"], (9,)) == ("start", None)


def test_copy_order_and_limits():
    assert graph.copy_order(["b", "a", "c"], [("a", "c")]) == (["b", "c", "a"], [])
    assert graph.copy_order(["a", "b", "x"], [("a", "b"), ("b", "a"), ("x", "a"), ("a", "nowhere")]) == (["a", "b", "x"], ["a", "b", "x"])
    clock = [0.0]
    limiter = routing.Limiter(100, lambda: clock[0], lambda s: clock.__setitem__(0, clock[0] + s))
    assert limiter.wait(100) == 0 and 0.99 <= limiter.wait(100) <= 1.01 and 4.9 <= limiter.wait(500) <= 5.1
    assert routing.Limiter(0).wait(10**9) == 0


def test_routes(spark):
    for bad in ("shop.a", "shop.a=sometimes"):
        with pytest.raises(ValueError):
            routing.parse(spark, bad)
    assert routing.parse(spark, " ").count() == 0
    told = []
    routing.run({"capture-triggers": lambda t: told.append(("captured", t)), "binlog": lambda t: told.append(("left out", t))}, routing.parse(spark, "Shop.A=capture-triggers,shop.b=binlog"))
    assert told == [("captured", ["shop.a"]), ("left out", ["shop.a"])]


def test_trigger_log_refuses(spark):
    log = spark.createDataFrame([(1, "t", "delete", '{"id":1}', None)], "cdc_id long, table_name string, operation string, old_row_json string, new_row_json string")
    empty = spark.createDataFrame([], "id int")
    with pytest.raises(triggerlog.Refused, match="no key"):
        triggerlog.apply_log(log, {"t": empty}, {}, "source-wins")
    with pytest.raises(triggerlog.Refused, match="conflict_zero_rows"):
        triggerlog.apply_log(log, {"t": empty}, {"t": ["id"]}, "fail")
    assert triggerlog.apply_log(log, {"t": empty}, {}, "fail", exclude=["T"])["t"].count() == 0


def test_trigger_log_runs(spark):
    schema = "cdc_id long, table_name string, operation string, old_row_json string, new_row_json string"
    logs = {"a": spark.createDataFrame([(i, "t", "insert", None, f'{{"id":{i}}}') for i in range(1, 6)], schema), "b": spark.createDataFrame([], schema)}
    written, saved, marks = {}, [], {"a": 1}

    def purge(database, last):
        raise OSError("no")

    args = dict(write=lambda d, t, f: written.__setitem__((d, t), sorted(r.id for r in f.collect())), save=lambda c: saved.append(dict(c)), purge=purge, limit=3)
    dest = {"a": {"t": spark.createDataFrame([(1,)], "id int"), "u": spark.createDataFrame([(9,)], "id int")}, "b": {}}
    assert triggerlog.run(logs, dest, {"a": {"t": ["id"]}}, marks, "fail", **args) == {"a": 3, "b": 0}
    assert written == {("a", "t"): [1, 2, 3, 4]} and saved == [{"a": 4}]


def test_statements_are_applied_in_order(spark):
    spark.createDataFrame([("d", 2, "CREATE VIEW ferryline_t.v AS SELECT 7 AS x"), ("d", 1, "CREATE DATABASE IF NOT EXISTS ferryline_t")], "database string, place int, statement string").createOrReplaceTempView("st")
    assert objects.apply_statements(spark, spark.table("st")) == 2 and spark.table("ferryline_t.v").first()["x"] == 7
    spark.sql("DROP DATABASE ferryline_t CASCADE")
    with pytest.raises(ValueError):
        objects.schema_statements(Catalog(spark), spark.createDataFrame([], "database string"), ("dream",))


def test_pinned_reads(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(3).write.parquet(path)
    held = copying.pinned(spark.read.parquet(path))
    spark.range(5).write.mode("append").parquet(path)
    assert held.count() == 3 and spark.read.parquet(path).count() == 8


def test_catalogs(spark):
    c = Catalog(spark)
    assert c.tables.count() == 0 and c.setting("version") is None
    with pytest.raises(AttributeError):
        c.tabels  # noqa: B018
    with pytest.raises(ValueError):
        Catalog(spark, tabels=None)
    assert prechecks.incompatible(prechecks.plan(checks.server(spark, checks.SOURCE), checks.server(spark, checks.DEST), checks=("data-shape",)))


def build(spark, path, facts, tables):
    for name, frame in checks.server(spark, facts)._frames.items():
        frame.write.parquet(f"{path}/catalog/{name}.parquet")
    for (database, table), df in tables.items():
        df.write.parquet(f"{path}/tables/{database}/{table}")


def test_command_line(spark, tmp_path):
    rows = spark.range(10).selectExpr("cast(id as int) as id")
    a, b, st = (str(tmp_path / x) for x in ("a", "b", "state"))
    log = [("b.000001", 10, "write_rows", 1, "shop", "t", "", [["50"]]), ("b.000001", 20, "xid", 1, "", "", "", []), ("b.000001", 30, "delete_rows", 1, "shop", "t", "", [["3"]]), ("b.000001", 40, "xid", 1, "", "", "", [])]
    build(spark, a, checks.QUIET, {("shop", "t"): rows})
    build(spark, b, checks.QUIET, {})
    spark.createDataFrame(log, "file string, pos long, kind string, ts long, schema string, `table` string, query string, rows array<array<string>>").write.parquet(f"{a}/log")

    def run(*argv):
        out = io.StringIO()
        code = cli.main(["--source", a, "--dest", b, "--state-dir", st, "--json", *argv], spark, out)
        return code, out.getvalue()

    code, out = run("plan")
    assert code == cli.OK and json.loads(out)["compatible"]
    assert run("report")[0] == cli.OK
    assert run("verify")[0] == cli.DIFFERS
    assert json.loads(run("--dry-run", "migrate")[1])["tables"] == {"shop/t": 10}
    assert json.loads(run("migrate", "--data-only")[1])["tables"] == {"shop/t": 10}
    for mode in ("count", "hash", "sample", "full-hash"):
        assert run("verify", "--data-mode", mode)[0] == cli.OK
    assert run("verify", "--verify-level", "schema", "--granular")[0] == cli.OK
    code, out = run("replicate")
    assert code == cli.OK and json.loads(out)["applied_events"] == 2
    assert sorted(r.id for r in spark.read.parquet(f"{b}/tables/shop/t").collect()) == [0, 1, 2, 4, 5, 6, 7, 8, 9, 50]
    assert json.loads(run("replicate")[1])["applied_events"] == 0
    assert run("verify")[0] == cli.OK and run("verify", "--data-mode", "hash")[0] == cli.DIFFERS  # the source folder is the state before the log
    assert json.loads(run("migrate-users")[1])["copied"] == 1
    assert run("report")[0] == cli.DIFFERS and run("report", "--fail-on-conflict", "false")[0] == cli.OK
    assert run("replicate", "--replication-mode", "hybrid")[0] == cli.DIFFERS
    for bad in (["nonsense"], ["replicate", "--start-from", "gtid"], ["replicate", "--start-pos", "1"], ["replicate", "--start-from", "binlog-file:pos", "--start-file", "b.1"], ["replicate", "--resume", "false", "--start-from", "binlog-file:pos", "--start-file", "../b"], ["replicate", "--idempotent"], ["replicate", "--replication-mode", "often"], ["verify", "--data-mode", "often"], ["--include-objects", "tables,dreams", "migrate"], ["migrate", "--schema-only", "--data-only"]):
        assert run(*bad)[0] == cli.USAGE, bad
    assert cli.main(["--dest", b, "--state-dir", st, "verify"], spark, io.StringIO()) == cli.USAGE
