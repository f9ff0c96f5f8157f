"""An ordered change log as frames: transactions, what makes a window fail, gates, mutations, and their application to tables.

Events are rows (file, pos, kind, ts, schema, table, query, rows): kinds are query, xid, write_rows, update_rows and delete_rows;
``rows`` is array<array<string>> of images, updates as old and new in turn.  Order is by log file number and position.  Sums over
the order run by ranges (``ordering.running``), so no task reads the whole log.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .ordering import running
from .tables import cut

EVENT = "file string, pos long, kind string, ts long, schema string, table string, query string, rows array<array<string>>"
ROW_KINDS = {"write_rows": "insert", "update_rows": "update", "delete_rows": "delete"}
# What a replay window may hold.
MAX_WINDOW_EVENTS, MAX_WINDOW_BYTES = 200_000, 64 << 20
POLICIES, DDL_POLICIES = ("fail", "source-wins", "dest-wins"), ("ignore", "warn", "apply")
FAILURE = ("failure_type", "file", "pos", "operation", "table_name", "query", "message", "remediation")

# Failure types by the error code of the server, with what to do.
SQL_ERRORS = {
    1062: "conflict_duplicate_key", 1451: "conflict_foreign_key", 1452: "conflict_foreign_key", 1054: "schema_drift", 1136: "schema_drift", 1146: "schema_drift", 1051: "schema_drift",
    1044: "permission_denied", 1045: "permission_denied", 1142: "permission_denied", 1366: "data_conversion_error", 1406: "data_conversion_error", 1265: "data_conversion_error", 1213: "retryable_transaction_error", 1205: "retryable_transaction_error",
}


def typed(raw: DataFrame) -> DataFrame:
    """Raw log events (event_type, ..) as typed events; types that carry no change are dropped."""
    name = F.upper("event_type")
    kind = F.when(name.startswith("QUERY"), "query").when(name.startswith("XID"), "xid").when(name.startswith("WRITE_ROWS"), "write_rows").when(name.startswith("UPDATE_ROWS"), "update_rows").when(name.startswith("DELETE_ROWS"), "delete_rows")
    return raw.withColumn("kind", kind).filter("kind is not null").select(*(c.rsplit(" ", 1)[0] if "array" not in c else "rows" for c in EVENT.split(", ")))


def window(events: DataFrame, start: tuple[str, int], end: tuple[str, int]) -> DataFrame:
    """Events after ``start`` up to ``end``, both (file, position)."""
    at = text.position(F.col("file"), F.col("pos"))
    bound = lambda p: text.position(F.lit(p[0]), F.lit(p[1]))
    return events.filter((at > bound(start)) & (at <= bound(end)))


def _is_row() -> Column:
    return F.col("kind").isin(*ROW_KINDS)


def sequenced(events: DataFrame, excluded: list[str] = ()) -> DataFrame:
    """Events in scope with their place ``seq``, their transaction ``txn`` and how that ends (``commit``, ``rollback`` or ``open``).

    ``excluded`` are lower-case ``schema.table`` names; their row events are left out.  A transaction is what lies between one end
    and the next.  The result is a table of its own, as several figures are taken from it.
    """
    word = F.upper(F.trim(F.coalesce("query", F.lit(""))))
    query = F.col("kind") == "query"
    mark = F.when(F.col("kind") == "xid", "commit").when(query & (word == "COMMIT"), "commit").when(query & (word == "ROLLBACK"), "rollback").when(query & word.isin("", "BEGIN"), "begin").when(query & text.ddl_class(F.col("query")).isNotNull(), "ddl").when(query, "unsupported").otherwise("rows")
    kept = events.filter(~(_is_row() & text.table_key(F.col("schema"), F.col("table")).isin([t.lower() for t in excluded]))) if excluded else events
    marked = kept.withColumn("mark", mark).withColumn("_at", text.position(F.col("file"), F.col("pos")))
    ends = F.col("mark").isin("commit", "rollback").cast("long")
    placed = running(marked.select("*", F.col("_at.file.prefix").alias("_p"), F.col("_at.file.number").alias("_n")).drop("_at"), ["_p", "_n", "pos"], {"seq": F.lit(1).cast("long"), "_ended": ends})
    placed = placed.withColumn("txn", F.col("_ended") - ends).drop("_ended", "_p", "_n")
    how = placed.filter("mark in ('commit', 'rollback')").select("txn", F.col("mark").alias("ending"))
    return cut(placed.join(how, "txn", "left").withColumn("ending", F.coalesce("ending", F.lit("open"))))


def with_keys(events: DataFrame, keys: DataFrame) -> DataFrame:
    """Events with ``columns`` (all of the table), ``key_columns`` and ``has_foreign_keys`` from (database, table, all_columns, columns, has_foreign_keys)."""
    k = keys.select(F.lower("database").alias("_d"), F.lower("table").alias("_t"), F.col("all_columns").alias("columns"), F.col("columns").alias("key_columns"), "has_foreign_keys")
    joined = events.withColumns({"_d": F.lower("schema"), "_t": F.lower("table")}).join(k, ["_d", "_t"], "left").drop("_d", "_t")
    return joined.withColumn("key_columns", F.coalesce("key_columns", F.array().cast("array<string>")))


def failures(events: DataFrame, *, ddl: str = "warn") -> DataFrame:
    """What stops the window, at most one row (FAILURE): the first in order of unsupported statements, statements that change the
    schema where the policy or row events in the window forbid them, row events after such a statement, updates and deletes of
    tables without a key, broken row images; else a transaction without an end."""
    if ddl not in DDL_POLICIES:
        raise ValueError(f"unsupported apply-ddl value {ddl!r}")
    firsts = events.agg(F.min(F.when(F.col("mark") == "rows", F.struct("seq", "file", "pos", "schema", "table"))).alias("row"), F.min(F.when(F.col("mark") == "ddl", F.struct("seq", "query"))).alias("ddl"))
    e = events.join(F.broadcast(firsts.withColumnsRenamed({"row": "first_row", "ddl": "first_ddl"})))  # one row
    name, place = F.concat_ws(".", "schema", "table"), F.concat(F.col("file"), F.lit(":"), F.col("pos").cast("string"))
    empty, none = F.lit(""), F.lit(None).cast("string")
    failed = lambda kind, operation, table, query, message, remedy, file=F.col("file"), pos=F.col("pos"): F.struct(*(c.alias(n) for c, n in zip((F.lit(kind), file, pos, F.lit(operation), table, query, message, F.lit(remedy)), FAILURE)))
    mixed = lambda row, query: failed("ddl_window_unsafe_live_metadata", "transaction", F.concat_ws(".", row["schema"], row["table"]), query, F.concat(F.lit("schema change and row events in one window at "), place), "split the window at the schema change, align the schema, then go on from the checkpoint", row["file"], row["pos"])
    after_row, after_ddl = F.col("first_row.seq") < F.col("seq"), F.col("first_ddl.seq") < F.col("seq")
    here = F.struct("schema", "table", "file", "pos")
    change = (
        F.when(after_row, mixed(F.col("first_row"), F.col("query")))
        .when(F.lit(ddl == "warn"), failed("ddl_blocked", "ddl", F.col("schema"), F.col("query"), F.concat(F.lit("schema change at "), place), "ignore schema changes here and apply them apart"))
        .when(F.lit(ddl == "apply") & (text.ddl_class(F.col("query")) != "safe"), failed("ddl_risky_blocked", "ddl", F.col("schema"), F.col("query"), F.concat(F.lit("risky schema change at "), place), "review the change and apply it apart"))
    )
    keyless = F.col("kind").isin("update_rows", "delete_rows") & (F.size("key_columns") == 0)
    keyed = lambda operation: failed("unsafe_keyless_replay", operation, name, empty, F.concat(F.lit(f"{operation} without a key on "), name), "add a primary key, or a unique key without nulls", none, F.lit(None).cast("long"))
    width = F.exists("rows", lambda r: F.size(r) != F.size("columns"))
    rows = (
        F.when(after_ddl, mixed(here, F.col("first_ddl.query")))
        .when(keyless, F.when(F.col("kind") == "update_rows", keyed("update")).otherwise(keyed("delete")))
        .when((F.col("kind") == "update_rows") & (F.size("rows") % 2 != 0), failed("replication_error", "update", name, empty, F.concat(F.lit("odd number of row images for "), name), "log full row images"))
        .when(F.col("columns").isNotNull() & width, failed("replication_error", "row", name, empty, F.concat(F.lit("row images do not match the columns of "), name), "log full row images"))
    )
    found = e.withColumn("failure", F.when(F.col("mark") == "unsupported", failed("unsupported_query_event", "query", empty, F.col("query"), F.concat(F.lit("unsupported statement at "), place), "align the schema apart, then go on")).when(F.col("mark") == "ddl", change).when(F.col("mark") == "rows", rows)).filter("failure is not null").select("seq", "failure")
    last = events.filter("mark = 'rows' and ending = 'open' and size(rows) > 0").agg(F.max(F.struct("seq", "file", "pos")).alias("l")).filter("l is not null")
    late = last.select(F.lit((1 << 62)).alias("seq"), failed("incomplete_transaction", "transaction", empty, empty, F.concat(F.lit("no end of the transaction at "), F.col("l.file"), F.lit(":"), F.col("l.pos").cast("string")), "read a longer window from the last checkpoint", F.col("l.file"), F.col("l.pos")).alias("failure"))
    first = found.unionByName(late).agg(F.min_by("failure", "seq").alias("f")).filter("f is not null")
    return first.select(*(F.coalesce(F.col(f"f.{c}"), empty).alias(c) if c != "pos" else F.col("f.pos").alias(c) for c in FAILURE))


def buffer_breach(events: DataFrame, max_events: int = MAX_WINDOW_EVENTS, max_bytes: int = MAX_WINDOW_BYTES) -> DataFrame:
    """The first event (file, pos, events, bytes, table_name) at which a window holds too much; 0 lifts a limit."""
    size = text.event_bytes(*(F.col(c) for c in ("file", "schema", "table", "query", "rows")))
    at = events.select("file", "pos", "schema", "table", size.alias("size"), text.position(F.col("file"), F.col("pos"))["file"].alias("_f")).select("*", F.col("_f.prefix").alias("_p"), F.col("_f.number").alias("_n")).drop("_f")
    summed = running(at, ["_p", "_n", "pos"], {"events": F.lit(1).cast("long"), "bytes": F.col("size")})
    over = summed.filter((F.lit(max_events > 0) & (F.col("events") > max_events)) | (F.lit(max_bytes > 0) & (F.col("bytes") > max_bytes)))
    name = F.when((F.trim(F.coalesce("schema", F.lit(""))) != "") & (F.trim(F.coalesce("table", F.lit(""))) != ""), F.concat_ws(".", "schema", "table")).otherwise("")
    return over.orderBy("events").limit(1).select(F.lit("source_window_buffer_limit_exceeded").alias("failure_type"), "file", "pos", "events", "bytes", name.alias("table_name"))


def mutations(events: DataFrame) -> DataFrame:
    """(txn, seq, place, op, table_name, key, old, new, keyless, has_foreign_keys) of committed transactions: one row for each changed row."""
    images = F.when(F.col("kind") == "update_rows", F.transform(F.sequence(F.lit(0), F.expr("size(rows) div 2 - 1")), lambda i: F.struct(F.get("rows", i * 2).alias("old"), F.get("rows", i * 2 + 1).alias("new")))).when(F.col("kind") == "write_rows", F.transform("rows", lambda r: F.struct(F.lit(None).cast("array<string>").alias("old"), r.alias("new")))).otherwise(F.transform("rows", lambda r: F.struct(r.alias("old"), F.lit(None).cast("array<string>").alias("new"))))
    done = events.filter("mark = 'rows' and ending = 'commit' and size(rows) > 0")
    out = done.select("txn", "seq", F.posexplode(images).alias("place", "i"), "kind", F.concat_ws(".", "schema", "table").alias("table_name"), "columns", "key_columns", F.coalesce("has_foreign_keys", F.lit(False)).alias("has_foreign_keys"))
    image = F.coalesce("i.old", "i.new")
    key = F.transform("key_columns", lambda k: F.get(image, F.array_position("columns", k).cast("int") - 1))
    op = F.create_map(*(F.lit(x) for pair in ROW_KINDS.items() for x in pair))[F.col("kind")]
    return out.select("txn", "seq", "place", op.alias("op"), "table_name", "columns", key.alias("key"), F.col("i.old").alias("old"), F.col("i.new").alias("new"), (F.size("key_columns") == 0).alias("keyless"), "has_foreign_keys")


def transactions(events: DataFrame, *, ddl: str = "ignore") -> DataFrame:
    """(txn, end_file, end_pos, end_ts, events, has_ddl, has_fk, keyless, keyless_tables) of what would be applied, in order of ``txn``.

    A schema change under ``apply`` is a transaction of its own, numbered by its place; others are numbered by the place of their end.
    """
    ends = events.filter("mark = 'commit'").select("txn", F.col("seq").alias("at"), F.col("file").alias("end_file"), F.col("pos").alias("end_pos"), F.col("ts").alias("end_ts"))
    m = mutations(events).groupBy("txn").agg(F.count("*").alias("events"), F.bool_or("has_foreign_keys").alias("has_fk"), F.count_if("keyless").alias("keyless"), F.array_sort(F.collect_set(F.when(F.col("keyless"), F.col("table_name")))).alias("keyless_tables"))
    rows = ends.join(m, "txn").select(F.col("at").alias("txn"), "end_file", "end_pos", "end_ts", "events", F.lit(False).alias("has_ddl"), "has_fk", "keyless", "keyless_tables")
    if ddl != "apply":
        return rows
    own = events.filter("mark = 'ddl'").select(F.col("seq").alias("txn"), F.col("file").alias("end_file"), F.col("pos").alias("end_pos"), F.col("ts").alias("end_ts"), F.lit(1).cast("long").alias("events"), F.lit(True).alias("has_ddl"), F.lit(False).alias("has_fk"), F.lit(0).cast("long").alias("keyless"), F.array().cast("array<string>").alias("keyless_tables"))
    return rows.unionByName(own)


def gates(txns: DataFrame, *, max_events: int = 0, max_lag_seconds: int = 0, now: int | Column = 0) -> DataFrame:
    """``txns`` with ``verdict``: ``apply``, ``later`` (beyond the limit on events), or the failure at which the run stops
    (``lag_limit_exceeded``, ``max_events_limit_too_low``), after which all is ``later``."""
    lag = text.lag_seconds(now if isinstance(now, Column) else F.lit(now), F.col("end_ts"))
    summed = running(txns.withColumn("late", (F.lit(max_lag_seconds > 0) & (F.coalesce("end_ts", F.lit(0)) > 0) & (lag > max_lag_seconds))), ["txn"], {"total": F.col("events"), "place": F.lit(1).cast("long")})
    over = F.lit(max_events > 0) & (F.col("total") > max_events)
    stop = F.when(F.col("late"), "lag_limit_exceeded").when(over & (F.col("place") == 1), "max_events_limit_too_low").when(over, "later")
    staged = summed.withColumn("stop", stop)
    first = staged.filter("stop is not null").agg(F.min("txn").alias("stopped_at"))
    verdict = F.when(F.col("stopped_at").isNull() | (F.col("txn") < F.col("stopped_at")), "apply").when(F.col("txn") == F.col("stopped_at"), F.col("stop")).otherwise("later")
    return staged.join(F.broadcast(first)).withColumn("verdict", verdict).drop("late", "stop", "stopped_at", "place")  # one row


def shape(judged: DataFrame, *, max_events: int = 0) -> DataFrame:
    """One row of figures on the transactions of ``gates``, the signals of risk they give, and its level."""
    done = F.col("verdict") == "apply"
    s = judged.agg(
        F.count("*").alias("transactions_seen"), F.count_if(done).alias("transactions_applied"), F.coalesce(F.sum("events"), F.lit(0)).alias("events_seen"), F.coalesce(F.sum(F.when(done, F.col("events"))), F.lit(0)).alias("applied_events"),
        F.coalesce(F.max("events"), F.lit(0)).alias("max_transaction_events"), F.count_if("has_ddl").alias("ddl_transactions"), F.count_if("has_fk").alias("fk_constrained_transactions"), F.coalesce(F.sum("keyless"), F.lit(0)).alias("keyless_operations"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("keyless_tables")))).alias("keyless_tables"),
    )
    s = s.withColumn("avg_transaction_events", F.expr("if(transactions_seen > 0, events_seen div transactions_seen, 0L)"))
    c, seen, most = F.col, F.col("transactions_seen"), F.col("max_transaction_events")
    signals = {
        "single_transaction_window": (seen == 1) & (c("events_seen") > 1),
        "large_transaction_dominates": (most >= 50) & ((seen == 1) | (most >= F.greatest(c("avg_transaction_events") * 5, F.lit(50)))),
        "ddl_serializes_apply": c("ddl_transactions") > 0,
        "foreign_key_serialization_pressure": c("fk_constrained_transactions") > 0,
        "keyless_row_matching_pressure": c("keyless_operations") > 0,
        "transaction_exceeds_max_events_limit": F.lit(max_events > 0) & (most > max_events),
        "window_cut_before_next_transaction": (c("transactions_applied") < seen) & (c("transactions_applied") > 0),
    }
    s = s.withColumn("risk_signals", F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in signals.items()))))
    medium = F.array(F.lit("window_cut_before_next_transaction"), F.lit("single_transaction_window"))
    return s.withColumn("risk_level", F.when(F.size("risk_signals") == 0, "").when(F.size(F.array_except("risk_signals", medium)) > 0, "high").otherwise("medium"))


def applied(dest: DataFrame, keys: list[str], changes: DataFrame, policy: str) -> DataFrame:
    """``dest`` after ``changes`` (seq, place, op, then the key and the columns of the new image) in order, under a policy.

    For each key only three places matter: the last delete, the first insert after it, and the last update (under source-wins also
    the last insert) after the row is there.  Each is an aggregation with partial sums, so a key with very many changes costs no
    more than the others.  Under ``dest-wins`` an insert gives way to a row that is there; under ``fail`` use ``conflicts`` first:
    without any, all policies agree.  An update that moves a row to another key is a delete and an insert in the log given.
    """
    if policy not in POLICIES:
        raise ValueError(f"unsupported conflict policy {policy!r}")
    at = F.struct("seq", "place")
    image = F.struct(*dest.columns)
    log = changes.select(*keys, at.alias("at"), "op", image.alias("image"))
    gone = log.filter("op = 'delete'").groupBy(*keys).agg(F.max("at").alias("gone"))
    alive = log.join(gone, keys, "left").filter("op <> 'delete' and (gone is null or at > gone)")
    born = alive.filter("op = 'insert'").groupBy(*keys).agg(F.min("at").alias("born"), F.max_by("image", "at").alias("last_insert"), F.min_by("image", "at").alias("first_insert"), F.max("at").alias("reborn"))
    kept = dest.join(gone.select(*keys), keys, "left_anti")
    state = kept.select(*keys, image.alias("here")).join(born, keys, "full_outer")
    updates = alive.filter("op = 'update'").select(*keys, "at", "image")
    # an update counts once the row is there: from the start, or after its first insert
    last = updates.join(state.select(*keys, "born", F.col("here").isNotNull().alias("there")), keys).filter("there or at > born").groupBy(*keys).agg(F.max_by("image", "at").alias("updated"), F.max("at").alias("updated_at"))
    inserted = F.coalesce("here", "first_insert") if policy == "dest-wins" else F.coalesce("last_insert", "here")
    newest = F.when(F.col("updated").isNull() | (F.lit(policy != "dest-wins") & (F.col("reborn") > F.col("updated_at"))), inserted).otherwise(F.col("updated"))
    return state.join(last, keys, "left").select(newest.alias("row")).select("row.*")


def conflicts(dest: DataFrame, keys: list[str], changes: DataFrame) -> DataFrame:
    """(seq, place, op, failure_type, keys) of changes that find no row to act on, or one that is in the way, in order: what stops
    a run under ``fail``.

    Whether a row is there before a change follows from the change of the same key before it, or from ``dest`` for the first.
    """
    from pyspark.sql.window import Window

    before = F.lag("op").over(Window.partitionBy(*keys).orderBy("seq", "place"))
    staged = changes.select(*keys, "seq", "place", "op").withColumn("before", before).join(dest.select(*keys).withColumn("here", F.lit(True)), keys, "left")
    there = F.when(F.col("before").isNull(), F.coalesce("here", F.lit(False))).otherwise(F.col("before") != "delete")
    kind = F.when((F.col("op") == "insert") & there, "conflict_duplicate_key").when((F.col("op") != "insert") & ~there, "conflict_zero_rows")
    return staged.withColumn("failure_type", kind).filter("failure_type is not null").select("seq", "place", "op", "failure_type", *keys).orderBy("seq", "place")


def as_rows(changes: DataFrame, dest: DataFrame, keys: list[str]) -> DataFrame:
    """``mutations`` of one table as changes with its columns; an update of the key is a delete of the old and an insert of the new."""
    def typed(image: str) -> list[Column]:
        return [F.get(image, F.array_position("columns", F.lit(f.name)).cast("int") - 1).cast(f.dataType).alias(f.name) for f in dest.schema.fields]

    new = changes.select("seq", "place", "op", F.struct(*typed("old")).alias("o"), F.struct(*typed("new")).alias("n"))
    moved = (F.col("op") == "update") & reduce(lambda a, b: a | b, (~F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys))
    steps = F.when(moved, F.array(F.struct((F.col("place") * 2).alias("place"), F.lit("delete").alias("op"), F.col("o").alias("r")), F.struct((F.col("place") * 2 + 1).alias("place"), F.lit("insert").alias("op"), F.col("n").alias("r")))).otherwise(F.array(F.struct((F.col("place") * 2).alias("place"), F.col("op"), F.when(F.col("op") == "delete", F.col("o")).otherwise(F.col("n")).alias("r"))))
    return new.select("seq", F.explode(steps).alias("s")).select("seq", "s.place", "s.op", "s.r.*")


def classified(errors: DataFrame) -> DataFrame:
    """(.., failure_type) for server errors (code int, message, operation); a lock wait of a schema change is told apart."""
    by_code = F.create_map(*(F.lit(x) for pair in SQL_ERRORS.items() for x in pair))
    message = F.upper(F.coalesce("message", F.lit("")))
    drift = message.contains("UNKNOWN COLUMN") | message.contains("DOESN'T EXIST")
    lock = F.col("code").isin(1213, 1205) & (F.lower(F.trim("operation")) == "ddl") & message.contains("METADATA LOCK")
    return errors.withColumn("failure_type", F.when(F.col("code").isNull(), F.when(drift, "schema_drift").otherwise("apply_sql_error")).when(lock, "metadata_lock_timeout").otherwise(F.coalesce(by_code[F.col("code")], F.lit("apply_sql_error"))))


def conflict_report(failure: DataFrame, *, start: tuple[str, int], source_end: tuple[str, int], applied_end: tuple[str, int] | None = None, ddl: str, policy: str, values: str = "redacted") -> DataFrame:
    """The report of a failure (FAILURE and optional samples): where the run stood, what failed, samples without values unless asked for."""
    samples = ("value_sample", "old_row_sample", "new_row_sample", "row_diff_sample")
    given = lambda c: F.col(c) if c in failure.columns else F.array().cast("array<string>")
    shown = lambda c: given(c) if values == "plain" else F.transform(given(c), text.redacted)
    done = applied_end or start
    blank = F.nullif(F.col("file"), F.lit(""))
    return failure.select(
        F.lit(1).alias("version"), F.lit(ddl).alias("apply_ddl"), F.lit(policy).alias("conflict_policy"), F.lit(start[0]).alias("start_file"), F.lit(start[1]).cast("long").alias("start_pos"), F.coalesce(blank, F.lit(source_end[0])).alias("source_end_file"),
        F.when(F.col("pos") > 0, F.col("pos")).otherwise(F.lit(source_end[1]).cast("long")).alias("source_end_pos"), F.lit(done[0]).alias("applied_end_file"), F.lit(done[1]).cast("long").alias("applied_end_pos"),
        "failure_type", "operation", "table_name", "query", "message", "remediation", F.lit(values != "plain").alias("values_redacted"), *(shown(c).alias(c) for c in samples),
    )
