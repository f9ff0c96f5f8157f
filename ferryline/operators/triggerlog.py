"""The change log that triggers keep in a table: reading by identifier, applying in order, checkpoints, purging.

Log rows are (cdc_id, table_name, operation, old_row_json, new_row_json).  Each database has a log of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .catalog import Catalog, base_tables
from .changelog import applied, conflicts

BATCH = 1000
EVENTS = ("insert", "update", "delete")


class Refused(ValueError):
    """A change that cannot be matched to rows."""


def setup_statements(catalog: Catalog, scope: DataFrame) -> DataFrame:
    """(database, table, event, statement): the log table of each database and three triggers a table, whose rows travel as JSON objects."""
    tables = base_tables(catalog, scope).filter(F.col("table") != text.LOG_TABLE)
    columns = catalog.columns.groupBy("database", "table").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column"))), lambda x: x["column"]).alias("columns"))
    each = tables.join(columns, ["database", "table"])
    log = text.qualified(F.col("database"), F.lit(text.LOG_TABLE))
    image = lambda side: F.concat(F.lit("JSON_OBJECT("), F.array_join(F.transform("columns", lambda c: F.concat(text.literal(c), F.lit(f", {side}."), text.quoted(c))), ", "), F.lit(")"))
    images = {"insert": ("NULL", image("NEW")), "update": (image("OLD"), image("NEW")), "delete": (image("OLD"), "NULL")}
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x

    def trigger(event: str):
        old, new = map(as_column, images[event])
        head = F.concat(F.lit("CREATE TRIGGER "), text.quoted(text.trigger_name(event, F.col("table"))), F.lit(f" AFTER {event.upper()} ON "), text.qualified(F.col("database"), F.col("table")))
        body = F.concat(F.lit(" FOR EACH ROW INSERT INTO "), log, F.lit(" (table_name, operation, old_row_json, new_row_json) VALUES ("), text.literal(F.col("table")), F.lit(f", '{event}', "), old, F.lit(", "), new, F.lit(")"))
        return F.struct(F.lit(event).alias("event"), F.concat(head, body).alias("statement"))

    triggers = each.select("database", "table", F.explode(F.array(*(trigger(e) for e in EVENTS))).alias("t")).select("database", "table", "t.event", "t.statement")
    create = F.concat(F.lit("CREATE TABLE IF NOT EXISTS "), log, F.lit(" (cdc_id BIGINT UNSIGNED NOT NULL AUTO_INCREMENT PRIMARY KEY, table_name VARCHAR(64) NOT NULL, operation VARCHAR(10) NOT NULL, old_row_json JSON, new_row_json JSON, captured_at TIMESTAMP(6) DEFAULT CURRENT_TIMESTAMP(6))"))
    logs = tables.select("database").distinct().select("database", F.lit("").alias("table"), F.lit("log").alias("event"), create.alias("statement"))
    return logs.unionByName(triggers).orderBy("database", "table", "event")


def teardown_statements(catalog: Catalog, scope: DataFrame) -> DataFrame:
    """(database, statement) that drop what ``setup_statements`` makes, triggers first."""
    tables = base_tables(catalog, scope).filter(F.col("table") != text.LOG_TABLE)
    drop = F.explode(F.array(*(F.concat(F.lit("DROP TRIGGER IF EXISTS "), text.qualified(F.col("database"), text.trigger_name(e, F.col("table")))) for e in EVENTS)))
    logs = tables.select("database").distinct().select("database", F.lit(1).alias("last"), F.concat(F.lit("DROP TABLE IF EXISTS "), text.qualified(F.col("database"), F.lit(text.LOG_TABLE))).alias("statement"))
    return tables.select("database", F.lit(0).alias("last"), drop.alias("statement")).unionByName(logs).orderBy("database", "last", "statement").select("database", "statement")


def missing_triggers(catalog: Catalog, scope: DataFrame) -> DataFrame:
    """(database, table, trigger) that should be there and are not, in order."""
    tables = base_tables(catalog, scope).filter(F.col("table") != text.LOG_TABLE)
    wanted = tables.select("database", "table", F.explode(F.array(*(text.trigger_name(e, F.col("table")) for e in EVENTS))).alias("trigger"))
    return wanted.join(catalog.triggers.select("database", "table", "trigger"), ["database", "table", "trigger"], "left_anti").orderBy("database", "table", "trigger")


def after(log: DataFrame, last_id: int, limit: int = BATCH) -> DataFrame:
    """The next log rows beyond a checkpoint."""
    return log.filter(F.col("cdc_id") > last_id).orderBy("cdc_id").limit(limit)


def purged(log: DataFrame, through: int) -> DataFrame:
    """The log without what a checkpoint covers."""
    return log.filter(F.col("cdc_id") > through)


def row_image(json: str, dest: DataFrame):
    """A row's JSON object as a struct of the table's columns; what the object lacks is null."""
    return F.from_json(F.col(json), dest.schema)


def as_changes(log: DataFrame, dest: DataFrame, keys: list[str]) -> DataFrame:
    """Log rows of one table as changes (seq, place, op, columns): an update that moves its key is a delete and an insert."""
    read = log.select(F.col("cdc_id").alias("seq"), F.lower("operation").alias("op"), row_image("old_row_json", dest).alias("o"), row_image("new_row_json", dest).alias("n"))
    image = F.when(F.col("op") == "delete", F.col("o")).otherwise(F.col("n"))
    moved = F.lit(False)
    for k in keys:
        moved = moved | ~F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).eqNullSafe(F.col(f"n.{k}"))
    part = lambda place, op, row: F.struct(F.lit(place).alias("place"), op.alias("op"), row.alias("r"))
    steps = F.when((F.col("op") == "update") & moved, F.array(part(0, F.lit("delete"), F.col("o")), part(1, F.lit("insert"), F.col("n")))).otherwise(F.array(part(0, F.col("op"), image)))
    return read.select("seq", F.explode(steps).alias("s")).select("seq", "s.place", "s.op", "s.r.*")


def apply_log(log: DataFrame, dest: dict[str, DataFrame], keys: dict[str, list[str]], policy: str, *, include: list[str] = (), exclude: list[str] = ()) -> dict[str, DataFrame]:
    """Each table of ``dest`` after the log rows that name it; updates and deletes need a key at the destination.

    Under ``fail`` a conflict refuses the batch as a whole.
    """
    out = {}
    for table, frame in dest.items():
        if (include and table.lower() not in {t.lower() for t in include}) or table.lower() in {t.lower() for t in exclude}:
            out[table] = frame
            continue
        own = log.filter(F.col("table_name") == table)
        if not keys.get(table):
            if not own.filter("lower(operation) <> 'insert'").isEmpty():
                raise Refused(f"no key at the destination for {table}")
            out[table] = frame.unionByName(own.select(row_image("new_row_json", frame).alias("n")).select("n.*"))
            continue
        changes = as_changes(own, frame, keys[table])
        if policy == "fail" and (first := conflicts(frame, keys[table], changes).limit(1).collect()):
            raise Refused(f"{first[0]['failure_type']} on {table} at {first[0]['seq']}")
        out[table] = applied(frame, keys[table], changes, policy)
    return out


def checkpoint(log: DataFrame) -> DataFrame:
    """(last_id, events) that a batch leads to; null where it is empty."""
    return log.agg(F.max("cdc_id").alias("last_id"), F.count("*").alias("events"))


def run(logs: dict[str, DataFrame], dest: dict[str, dict[str, DataFrame]], keys: dict[str, dict[str, list[str]]], checkpoints: dict[str, int], policy: str, *, write, save, purge=None, limit: int = BATCH, **scope) -> dict[str, int]:
    """One batch of each database's log: apply, ``write(database, table, frame)`` what changed, ``save`` the checkpoint, then ``purge``
    what it covers.  A purge that fails is told in the log and does not fail the run.  Events applied by database."""
    import logging

    done = {}
    for database in sorted(logs):
        batch = after(logs[database], checkpoints.get(database, 0), limit)
        last = checkpoint(batch).first()
        done[database] = last["events"]
        if not last["events"]:
            continue
        named = {r["table_name"] for r in batch.select("table_name").distinct().collect()}  # at most ``limit`` rows
        tables = {t: df for t, df in dest[database].items() if t in named}
        for table, frame in apply_log(batch, tables, keys.get(database, {}), policy, **scope).items():
            write(database, table, frame)
        checkpoints[database] = last["last_id"]
        save(checkpoints)
        if purge is not None:
            try:
                purge(database, last["last_id"])
            except Exception as e:  # noqa: BLE001  what stays is skipped by the checkpoint
                logging.getLogger("ferryline").warning("purge of %s failed: %s", database, e)
    return done
