"""The twelve checks before a move: catalog frames of both servers and a scope in, findings out.

A check returns (precheck, code, severity, message, proposal) rows; a severity of ``error`` makes a pair incompatible.  Settings of
a server are few and read on the driver, inventories stay frames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import graph
from .catalog import Catalog, base_tables, keyless_tables, selected, within

FINDING = "precheck string, code string, severity string, message string, proposal string"

# Words taken for reserved where the destination does not list its own.
RESERVED = "CUBE CUME_DIST DENSE_RANK EMPTY EXCEPT FIRST_VALUE FUNCTION GROUPS INTERSECT JSON_TABLE LAG LAST_VALUE LATERAL LEAD NTH_VALUE NTILE OF OVER PERCENT_RANK RANK RECURSIVE ROW_NUMBER SEQUENCE SYSTEM WINDOW".split()


class Findings:
    """Collects the findings of one check."""

    def __init__(self, name: str, catalog: Catalog):
        self.name, self.spark, self.rows, self.frames, self.issues = name, catalog.spark, [], [], []

    def tell(self, code: str, severity: str, message: str, proposal: str = "") -> None:
        self.rows.append((self.name, code, severity, message, proposal))

    def each(self, issues: DataFrame, code: str, severity: str | Column, message: Column, proposal: Column | str = "") -> None:
        as_column = lambda x: F.lit(x) if isinstance(x, str) else x
        self.frames.append(issues.select(F.lit(self.name).alias("precheck"), F.lit(code).alias("code"), as_column(severity).alias("severity"), message.alias("message"), as_column(proposal).alias("proposal")))

    def summed(self, issues: DataFrame, code: str, severity: str, what: str, proposal: str) -> None:
        """One finding that counts the issues, if there are any."""
        self.issues.append(issues)
        n = issues.agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
        self.each(n, code, severity, F.concat(F.col("n").cast("string"), F.lit(f" {what}")), proposal)

    def clean(self, code: str, message: str) -> None:
        """A finding that says so where none of the summed issues exists."""
        n = reduce(DataFrame.union, (i.select(F.lit(1).alias("one")) for i in self.issues)).agg(F.count("one").alias("n")).filter("n = 0")
        self.each(n, code, "info", F.lit(message), "Keep this result as evidence.")

    def frame(self) -> DataFrame:
        told = self.spark.createDataFrame(self.rows, FINDING)
        return reduce(DataFrame.unionByName, [told, *self.frames])


def _scope(source: Catalog, include, exclude) -> DataFrame:
    return selected(source.databases, list(include), list(exclude))


def _place(*names: str) -> Column:
    return F.concat_ws(".", *names)


def zero_dates(source: Catalog, dest: Catalog, include=(), exclude=()) -> DataFrame:
    """Temporal defaults with zero parts, where the destination refuses them."""
    f = Findings("zero-date", source)
    if strict(dest):
        bad = zero_date_columns(source, _scope(source, include, exclude))
        f.summed(bad, "zero_date_defaults_incompatible", "error", "temporal defaults hold a zero date", "Give the columns valid defaults; a script of statements can be written.")
        f.each(bad, "zero_date_default_column", "error", F.concat(_place("database", "table", "column"), F.lit(" defaults to "), "default"), F.col("fix"))
    return f.frame()


def strict(dest: Catalog) -> bool:
    mode = dest.setting("sql_mode") or ""
    return bool(dest.spark.range(1).select(text.refuses_zero_dates(F.lit(mode))).first()[0])


def zero_date_columns(source: Catalog, scope: DataFrame) -> DataFrame:
    kind = F.lower("data_type")
    bad = within(source.columns, scope).filter(kind.isin("date", "datetime", "timestamp") & text.zero_date(F.col("default")))
    return bad.select("database", "table", "column", kind.alias("data_type"), "default", text.default_fix(F.col("database"), F.col("table"), F.col("column"), kind).alias("fix"))


def fix_script(source: Catalog, scope: DataFrame) -> DataFrame:
    """The statements that mend zero-date defaults, each once, in order."""
    return zero_date_columns(source, scope).select("fix").distinct().orderBy("fix")


def plugins(source: Catalog, dest: Catalog, include=(), exclude=()) -> DataFrame:
    """Accounts whose plugin, and tables whose engine, the destination lacks."""
    f = Findings("plugin-lifecycle", source)
    mode = dest.setting("sql_mode")
    if mode is None:
        f.tell("destination_sql_mode_inventory_unavailable", "warn", "The destination's sql_mode cannot be read.", "Review it by hand.")
    elif "NO_ENGINE_SUBSTITUTION" not in {m.strip() for m in mode.upper().split(",")}:
        f.tell("destination_no_engine_substitution_disabled", "warn", "The destination may replace an engine it lacks without an error.", "Switch NO_ENGINE_SUBSTITUTION on.")
    if dest.setting("default_authentication_plugin") is None:
        f.tell("destination_default_auth_plugin_variable_unavailable", "warn", "The destination names no default authentication plugin.", "Normalise the plugins of accounts explicitly.")
    accounts = unsupported_accounts(source, dest)
    if source.accounts.isEmpty():
        f.tell("source_auth_plugin_inventory_unavailable", "warn", "The source lists no accounts.", "Grant access to the account tables, or review accounts by hand.")
    if dest.plugins.isEmpty():
        f.tell("destination_plugin_inventory_unavailable", "warn", "The destination lists no plugins.", "Review plugins by hand.")
    f.summed(accounts, "unsupported_auth_plugins_detected", "warn", "accounts use a plugin the destination lacks", "Recreate them with a plugin both sides have.")
    f.each(accounts, "unsupported_auth_plugin_account", "warn", F.concat(text.account(F.col("user"), F.col("host")), F.lit(" ("), "account_class", F.lit(") uses "), "plugin"), "Recreate the account with a supported plugin.")
    scope = _scope(source, include, exclude)
    if scope.isEmpty():
        f.tell("plugin_lifecycle_no_selected_databases", "info", "No database is in scope.", "Check the filters.")
        return f.frame()
    tables = unsupported_engines(source, dest, scope)
    f.summed(tables, "unsupported_storage_engines_detected", "error", "tables use an engine the destination lacks", "Convert them first, or leave them out.")
    f.each(tables, "unsupported_storage_engine_table", "error", F.concat(_place("database", "table"), F.lit(" uses "), "engine", F.lit(": "), "support"), "Convert the table to an engine both sides have.")
    f.clean("plugin_lifecycle_inventory_clean", "Every plugin and engine in use is there on the destination.")
    return f.frame()


def unsupported_accounts(source: Catalog, dest: Catalog) -> DataFrame:
    """Accounts whose plugin is not active there, in order; nothing is known of a destination that lists none."""
    active = dest.plugins.filter("upper(status) in ('ACTIVE', 'ENABLED')").select(F.col("name").alias("plugin"))
    known = active.limit(1).select(F.lit(1).alias("listed"))
    bad = source.accounts.filter("coalesce(plugin, '') <> ''").join(active, "plugin", "left_anti").join(F.broadcast(known), F.lit(True), "left_semi")
    return bad.select("user", "host", "plugin", text.account_class(F.col("user")).alias("account_class")).orderBy("user", "host", "plugin")


def unsupported_engines(source: Catalog, dest: Catalog, scope: DataFrame) -> DataFrame:
    """(database, table, engine, support) where the destination does not support the engine, ``MISSING`` where it has none such."""
    held = dest.engines.select("engine", F.upper("support").alias("support"))
    used = within(source.tables, scope).filter("table_type = 'BASE TABLE' and coalesce(engine, '') <> ''").select("database", "table", "engine")
    if dest.engines.isEmpty():
        return used.withColumn("support", F.lit("MISSING")).limit(0)
    found = used.join(held, "engine", "left").withColumn("support", F.coalesce("support", F.lit("MISSING")))
    return found.filter("support not in ('YES', 'DEFAULT')").select("database", "table", "engine", "support").orderBy("database", "table")


def hidden_parts(source: Catalog, scope: DataFrame) -> dict[str, DataFrame]:
    extra = F.upper(F.coalesce("extra", F.lit("")))
    columns = within(source.columns, scope).withColumn("hidden", extra.contains("INVISIBLE")).filter("hidden")
    own = (F.col("column_key") == "PRI") & extra.contains("AUTO_INCREMENT")
    return {
        "column": columns.filter(~(F.coalesce(own, F.lit(False)) & (F.col("column") == "my_row_id"))).select("database", "table", "column").orderBy("database", "table", "column"),
        "index": within(source.index_parts, scope).filter("index <> 'PRIMARY' and upper(coalesce(visible, 'YES')) = 'NO'").select("database", "table", "index").distinct().orderBy("database", "table", "index"),
        "key": columns.filter(F.coalesce(own, F.lit(False))).select("database", "table", "column").orderBy("database", "table", "column"),
    }


def invisible(source: Catalog, dest: Catalog, include=(), exclude=()) -> DataFrame:
    """Invisible columns, indexes and generated keys, and whether the destination knows such things."""
    f, a, b = Findings("invisible-gipk", source), source.instance(), dest.instance()
    scope = _scope(source, include, exclude)
    if scope.isEmpty():
        f.tell("invisible_gipk_no_selected_databases", "info", "No database is in scope.", "Check the filters.")
        return f.frame()
    parts = hidden_parts(source, scope)
    if a["engine"] != "mysql":
        parts["index"], parts["key"] = parts["index"].limit(0), parts["key"].limit(0)
    n = {k: df.count() for k, df in parts.items()}
    v = (b["major"] or 0, b["minor"] or 0, b["patch"] or 0)
    my, maria = b["engine"] == "mysql", b["engine"] == "mariadb"
    columns_ok, indexes_ok, keys_ok = (my and v >= (8, 0, 23)) or (maria and v >= (10, 3, 3)), my and v >= (8, 0, 0), my and v >= (8, 0, 30)
    drift = (n["column"] > 0 and not columns_ok) or (n["index"] > 0 and not indexes_ok)
    lost = n["key"] > 0 and not keys_ok
    shown = source.setting("show_gipk_in_create_table_and_information_schema")
    if a["engine"] == "mysql" and shown is not None and shown.strip().upper() in ("0", "OFF", "FALSE"):
        f.tell("source_show_gipk_disabled", "warn", "The source hides generated keys from its catalog.", "Show them before planning.")
    if not sum(n.values()):
        f.tell("invisible_gipk_inventory_clean", "info", "No invisible column, index or generated key.", "Keep this result as evidence.")
        return f.frame()
    f.tell("invisible_gipk_features_detected", "error" if drift or lost else "warn", f"{n['column']} invisible columns, {n['index']} invisible indexes, {n['key']} generated keys", "Make them visible, or drop them, where the destination does not know them.")
    f.each(parts["column"], "invisible_column_detected", "error" if drift else "info", _place("database", "table", "column"))
    f.each(parts["index"], "invisible_index_detected", "error" if drift else "info", _place("database", "table", "index"))
    f.each(parts["key"], "generated_invisible_primary_key_detected", "error" if lost else "warn", _place("database", "table", "column"))
    return f.frame()


def used_collations(source: Catalog, scope: DataFrame) -> DataFrame:
    """(scope, database, table, column, collation) of databases, tables and columns that name one, each once."""
    none = F.lit("")
    at = [
        within(source.databases, scope).select(F.lit("schema").alias("scope"), "database", none.alias("table"), none.alias("column"), "collation"),
        within(source.tables, scope).select(F.lit("table").alias("scope"), "database", "table", none.alias("column"), "collation"),
        within(source.columns, scope).select(F.lit("column").alias("scope"), "database", "table", "column", "collation"),
    ]
    return reduce(DataFrame.unionByName, at).filter("coalesce(collation, '') <> ''").dropDuplicates(["scope", "database", "table", "column", "collation"])


def unsupported_collations(source: Catalog, dest: Catalog, scope: DataFrame) -> DataFrame:
    known = dest.collations.select(F.explode(text.collation_names(F.col("name"))).alias("folded")).filter("folded <> ''").distinct()
    used = used_collations(source, scope).withColumn("folded", F.lower(F.trim("collation")))
    return used.join(known, "folded", "left_anti").drop("folded").orderBy("database", "table", "column", "scope")


def collations(source: Catalog, dest: Catalog, include=(), exclude=()) -> DataFrame:
    """Collations the destination lacks, and families that clients may not know."""
    f, scope = Findings("collation", source), _scope(source, include, exclude)
    if scope.isEmpty():
        f.tell("collation_precheck_no_selected_databases", "info", "No database is in scope.", "Check the filters.")
        return f.frame()
    lacking = unsupported_collations(source, dest, scope)
    servers = [(f"{side}-server", "", "", "", c) for side, cat in (("source", source), ("dest", dest)) if (c := cat.setting("collation_server"))]
    everywhere = used_collations(source, scope).unionByName(source.spark.createDataFrame(servers, "scope string, database string, `table` string, `column` string, collation string"))
    risky = everywhere.filter(F.lower("collation").contains("uca1400"))
    where = F.concat("scope", F.lit(" "), F.concat_ws(".", *(F.nullif(F.col(c), F.lit("")) for c in ("database", "table", "column"))), F.lit(": "), "collation")
    f.summed(lacking, "unsupported_destination_collations_detected", "error", "uses of a collation the destination lacks", "Replace them with one that both sides have.")
    f.each(lacking, "unsupported_destination_collation", "error", where, "Replace the collation before the move.")
    f.summed(risky, "client_collation_compatibility_risk_detected", "warn", "uses of a collation that clients may not know", "Rehearse drivers against it.")
    f.each(risky, "client_collation_compatibility_risk", "warn", where, "Rehearse drivers against it.")
    f.clean("collation_inventory_clean", "The destination has every collation in use.")
    return f.frame()


def schema_features(source: Catalog, dest: Catalog, include=(), exclude=()) -> DataFrame:
    """JSON columns across engines; sequences and system-versioned tables of one engine."""
    f, scope, a, b = Findings("schema-feature", source), _scope(source, include, exclude), source.instance()["engine"], dest.instance()["engine"]
    if scope.isEmpty():
        f.tell("schema_feature_no_selected_databases", "info", "No database is in scope.", "Check the filters.")
        return f.frame()
    nothing = source.tables.limit(0)
    json = within(source.columns, scope).filter("lower(data_type) = 'json'") if a != b else source.columns.limit(0)
    sequences = within(source.sequences, scope) if a == "mariadb" else source.sequences.limit(0)
    versioned = within(source.tables, scope).filter((F.col("table_type") == "BASE TABLE") & F.col("create_sql").rlike(r"(?i)\bWITH\s+SYSTEM\s+VERSIONING\b")) if a == "mariadb" else nothing
    severity, suffix = ("warn", "_detected") if b == "mariadb" else ("error", "_unsupported_on_destination")
    f.summed(json, "cross_engine_json_columns_detected", "error", "JSON columns cross engines", "Convert them to text with a check, or stay on one engine.")
    f.each(json, "cross_engine_json_column", "error", _place("database", "table", "column"))
    f.summed(sequences, f"mariadb_sequences{suffix}", severity, "sequences", "Replace them by counters of columns where the destination has none.")
    f.each(sequences, "mariadb_sequence_object", severity, _place("database", "name"))
    f.summed(versioned, f"system_versioned_tables{suffix}", severity, "system-versioned tables", "Drop versioning, or keep history in a table of its own.")
    f.each(versioned, "system_versioned_table", severity, _place("database", "table"))
    f.clean("schema_feature_inventory_clean", "No feature of one engine alone is in use.")
    return f.frame()


def reserved_words(catalog: Catalog) -> DataFrame:
    """(word) in upper case; a server that lists none gets the built-in words."""
    own = catalog.keywords.filter("coalesce(reserved, 1) <> 0").select(F.upper(F.trim("word")).alias("word")).filter("word <> ''").distinct()
    if not own.isEmpty():
        return own
    v = catalog.instance()
    words = [*RESERVED, *(["LIBRARY"] if v["engine"] == "mysql" and (v["major"] or 0) >= 9 else [])]
    return catalog.spark.createDataFrame([(w,) for w in words], "word string")


def named_things(source: Catalog, scope: DataFrame) -> DataFrame:
    """(database, object_type, object_name, identifier) of databases, tables, views and columns in scope."""
    kind = F.when(F.col("table_type") == "VIEW", "view").otherwise("table")
    return (
        scope.select("database", F.lit("database").alias("object_type"), F.col("database").alias("object_name"), F.col("database").alias("identifier"))
        .unionByName(within(source.tables, scope).select("database", kind.alias("object_type"), F.col("table").alias("object_name"), F.col("table").alias("identifier")))
        .unionByName(within(source.columns, scope).select("database", F.lit("column").alias("object_type"), F.col("table").alias("object_name"), F.col("column").alias("identifier")))
    )


def reserved_identifiers(source: Catalog, dest: Catalog, scope: DataFrame) -> DataFrame:
    """Things named by a word that is reserved there, and whether it is so there alone."""
    there, here = reserved_words(dest), reserved_words(source).withColumn("here", F.lit(True))
    found = named_things(source, scope).withColumn("word", F.upper(F.trim("identifier"))).join(there, "word").join(here, "word", "left")
    return found.select("database", "object_type", "object_name", "identifier", F.col("here").isNull().alias("destination_only")).orderBy("database", "object_type", "object_name", "identifier")


def case_collisions(source: Catalog, scope: DataFrame) -> DataFrame:
    """(database, object_type, folded_name, objects): names that fall together once case is folded - databases, and tables and views of one database."""
    bases = scope.groupBy(F.lower("database").alias("folded_name")).agg(F.array_sort(F.collect_list("database")).alias("objects")).select(F.lit("").alias("database"), F.lit("database").alias("object_type"), "folded_name", "objects")
    inner = within(source.tables, scope).groupBy("database", F.lower("table").alias("folded_name")).agg(F.array_sort(F.collect_list("table")).alias("objects")).select("database", F.lit("table/view").alias("object_type"), "folded_name", "objects")
    return bases.unionByName(inner).filter("size(objects) > 1").orderBy("database", "object_type", "folded_name")


def view_drift(source: Catalog, scope: DataFrame, source_mode: str | None, dest_mode: str | None) -> DataFrame:
    """(database, view, mode): views that read otherwise under a parser mode that only one side has."""
    views = within(source.objects, scope).filter("object_type = 'view'").select("database", F.col("name").alias("view"), text.code_only(F.col("create_sql")).alias("code"))
    tokens = lambda m: {x.strip() for x in (m or "").upper().split(",")}
    signs = {"ANSI_QUOTES": '"', "PIPES_AS_CONCAT": "||", "NO_BACKSLASH_ESCAPES": "\\\\"} if (source_mode or "").strip() and (dest_mode or "").strip() else {}
    differ = [m for m in signs if (m in tokens(source_mode)) != (m in tokens(dest_mode))]
    found = F.array_compact(F.array(*(F.when(F.col("code").contains(signs[m]), F.lit(m)) for m in differ))) if differ else F.array().cast("array<string>")
    return views.select("database", "view", F.explode(found).alias("mode")).orderBy("database", "view", "mode")


def identifiers(source: Catalog, dest: Catalog, include=(), exclude=()) -> DataFrame:
    """Names and views that the destination would read otherwise."""
    f, scope = Findings("identifier-portability", source), _scope(source, include, exclude)
    if scope.isEmpty():
        f.tell("identifier_portability_no_selected_databases", "info", "No database is in scope.", "Check the filters.")
        return f.frame()
    modes, cases = {}, {}
    for side, cat in (("source", source), ("dest", dest)):
        modes[side], cases[side] = cat.setting("sql_mode"), cat.setting("lower_case_table_names")
        if modes[side] is None:
            f.tell(f"identifier_portability_{side}_sql_mode_unavailable", "warn", f"The {side} sql_mode cannot be read.", "Compare parser modes by hand.")
        if cases[side] is None:
            f.tell(f"{side}_lower_case_table_names_unavailable", "warn", f"The {side} lower_case_table_names cannot be read.", "Record it by hand.")
        if cat.keywords.isEmpty():
            f.tell(f"{side}_reserved_word_inventory_fallback", "warn", f"The {side} lists no reserved words; built-in words are used.", "Review names by hand.")
    if any(c is not None for c in cases.values()):
        f.tell("lower_case_table_names_inventory_recorded", "info", f"lower_case_table_names: source {cases['source']}, destination {cases['dest']}", "Keep this result as evidence.")
    if None not in cases.values() and cases["source"].strip() != cases["dest"].strip():
        f.tell("lower_case_table_names_mismatch", "error", "lower_case_table_names differs.", "Make both sides alike before the move.")
    fold = any(c is not None and c.strip() != "0" for c in cases.values())
    clash, words, views = case_collisions(source, scope), reserved_identifiers(source, dest, scope), view_drift(source, scope, modes["source"], modes["dest"])
    mixed = named_things(source, scope).filter((F.col("object_type") != "column") & text.mixed_case(F.col("identifier")))
    f.summed(clash, "case_fold_collisions_detected", "error", "names fall together once case is folded", "Rename them.")
    f.each(clash, "case_fold_collision", "error", F.concat("object_type", F.lit(" "), F.concat_ws(", ", "objects")))
    f.summed(mixed, "mixed_case_identifiers_detected", "error" if fold else "warn", "names mix upper and lower case", "Settle on one case.")
    f.each(mixed, "mixed_case_identifier", "error" if fold else "warn", F.concat("object_type", F.lit(" "), "identifier"))
    only = words.filter("destination_only")
    new = not only.isEmpty()
    f.summed(words, f"destination_reserved_identifiers_{'detected' if new else 'warn_only'}", "error" if new else "warn", "names are reserved words there", "Rename them, or quote every reference.")
    f.each(only, "destination_reserved_identifier", "error", F.concat("object_type", F.lit(" "), "identifier"))
    f.each(words.filter("not destination_only"), "destination_reserved_identifier_warn_only", "warn", F.concat("object_type", F.lit(" "), "identifier"))
    f.summed(views, "view_parser_drift_detected", "error", "views depend on a parser mode that differs", "Rewrite them.")
    f.each(views, "view_parser_drift_risk", "error", F.concat("database", F.lit("."), "view", F.lit(": "), "mode"))
    f.clean("identifier_portability_inventory_clean", "Names and views read the same on both sides.")
    return f.frame()


def foreign_key_cycles(source: Catalog, dest: Catalog, include=(), exclude=()) -> DataFrame:
    f = Findings("foreign-key-cycle", source)
    groups = graph.cycles(graph.edges(source, _scope(source, include, exclude)))
    f.summed(groups, "foreign_key_cycles_detected", "error", "groups of tables need each other", "Break the cycle, or load with checks off and validate after.")
    f.each(groups, "foreign_key_cycle_group", "error", F.concat("database", F.lit(": "), F.concat_ws(", ", "tables")))
    f.clean("foreign_key_cycle_inventory_clean", "Foreign keys have no cycle.")
    return f.frame()


def replication_boundary(source: Catalog, dest: Catalog, include=(), exclude=()) -> DataFrame:
    """What does not cross from one engine's change log to the other's."""
    f, a, b = Findings("replication-boundary", source), source.instance()["engine"], dest.instance()["engine"]
    if a == b:
        f.tell("replication_boundary_same_engine_inventory_skipped", "info", "Both sides run one engine.", "Nothing to do.")
        return f.frame()
    f.tell("cross_engine_gtid_boundary_detected", "warn", "Transaction identifiers do not carry over between engines.", "Replicate by file and position.")
    names = ("gtid_mode", "gtid_executed", "gtid_current_pos", "gtid_strict_mode")
    if any((c.setting(n) or "").strip() for c in (source, dest) for n in names):
        f.tell("cross_engine_gtid_state_inventory_recorded", "warn", "Identifier state is there on a side.", "Do not reuse it on the other.")
    on = source.setting("log_bin")
    if on is not None and on.strip().upper() in ("0", "OFF", "FALSE"):
        f.tell("cross_engine_replication_source_log_bin_disabled", "warn", "The source keeps no change log.", "Switch it on.")
    form = (source.setting("binlog_format") or "").strip().upper()
    if form and form != "ROW":
        f.tell("cross_engine_replication_non_row_binlog_format", "warn", f"The change log holds {form}.", "Log rows.")
    if (a, b) == ("mysql", "mariadb"):
        if (source.setting("binlog_row_value_options") or "").strip():
            f.tell("mysql_to_mariadb_binlog_row_value_options_set", "warn", "Partial row values are logged.", "Clear the option.")
        if (source.setting("binlog_transaction_compression") or "").strip().upper() in ("ON", "1"):
            f.tell("mysql_to_mariadb_binlog_transaction_compression_enabled", "warn", "Logged transactions are compressed.", "Switch compression off.")
    return f.frame()


def replication_readiness(source: Catalog, dest: Catalog, include=(), exclude=()) -> DataFrame:
    """Can changes be replayed from the source's log?"""
    f, a, b = Findings("replication-readiness", source), source.instance()["engine"], dest.instance()["engine"]
    on, form, image = (source.setting(n) for n in ("log_bin", "binlog_format", "binlog_row_image"))
    if on is None and form is None and image is None:
        f.tell("replication_readiness_inventory_unavailable", "warn", "The log's settings cannot be read.", "Grant access to them.")
    word = (on or "").strip().upper()
    if on is not None and word not in ("1", "ON", "TRUE", "0", "OFF", "FALSE"):
        f.tell("replication_readiness_log_bin_parse_failed", "warn", f"log_bin is {on!r}.", "Read it by hand.")
    there = source.setting("binlog_file", "log_file") is not None
    if not there:
        f.tell("replication_readiness_master_status_unavailable", "warn", "The source tells no log position.", "Grant the replication client privilege.")
    if word in ("0", "OFF", "FALSE"):
        f.tell("replication_readiness_source_log_bin_disabled", "warn", "The source keeps no change log.", "Switch it on.")
    if (form or "").strip() and form.strip().upper() != "ROW":
        f.tell("replication_readiness_non_row_binlog_format", "warn", f"The change log holds {form}.", "Log rows.")
    if (image or "").strip() and image.strip().upper() != "FULL":
        f.tell("replication_readiness_non_full_row_image", "warn", f"Row images are {image}.", "Log full images.")
    if there:
        f.tell("replication_readiness_binary_log_status_recorded", "info", "The source tells its log position.", "Keep it for the first run.")
    if a != b:
        f.tell("replication_readiness_cross_engine_lane", "warn", "The engines differ.", "Replicate by file and position.")
    if not f.rows:
        f.tell("replication_readiness_inventory_clean", "info", "Changes can be replayed.", "Keep this result as evidence.")
    return f.frame()


def temporal_tables(source: Catalog, scope: DataFrame) -> DataFrame:
    """(database, table, timestamps, datetimes) of tables that have any."""
    kind = F.lower("data_type")
    found = within(source.columns, scope).groupBy("database", "table").agg(F.count_if(kind == "timestamp").alias("timestamps"), F.count_if(kind == "datetime").alias("datetimes"))
    return found.filter("timestamps > 0 or datetimes > 0").orderBy("database", "table")


def zone_of(catalog: Catalog) -> str:
    zone, system = (catalog.setting("time_zone") or "").strip(), (catalog.setting("system_time_zone") or "").strip()
    return system if zone.upper() == "SYSTEM" else zone


def time_zones(source: Catalog, dest: Catalog, include=(), exclude=()) -> DataFrame:
    """Do times mean the same on both sides?"""
    f, scope = Findings("timezone-portability", source), _scope(source, include, exclude)
    if scope.isEmpty():
        f.tell("timezone_portability_no_selected_databases", "info", "No database is in scope.", "Check the filters.")
        return f.frame()
    f.tell("timezone_inventory_recorded", "info", f"Zones: source {zone_of(source)}, destination {zone_of(dest)}", "Keep this result as evidence.")
    drift = zone_of(source) != zone_of(dest)
    if drift:
        f.tell("timezone_environment_drift_detected", "warn", "The zones in force differ.", "Pin sessions to UTC.")
    tables = temporal_tables(source, scope)
    mixed = (F.col("timestamps") > 0) & (F.col("datetimes") > 0)
    f.summed(tables.filter(mixed), "mixed_timestamp_datetime_tables_detected", "warn", "tables mix instants and wall-clock times", "Rehearse reads in both zones.")
    shown = F.concat(_place("database", "table"), F.lit(": "), F.col("timestamps").cast("string"), F.lit(" timestamp, "), F.col("datetimes").cast("string"), F.lit(" datetime"))
    f.each(tables.filter(mixed), "mixed_timestamp_datetime_table", "warn", shown)
    review = ~mixed & (F.col("timestamps") > 0) & F.lit(drift)
    f.each(tables.filter(review), "timestamp_table_timezone_review", "warn", shown)
    f.each(tables.filter(~mixed & ~review), "temporal_table_inventory", "info", shown)
    f.issues = [tables]
    f.clean("timezone_temporal_inventory_clean", "No table holds timestamps or datetimes.")
    return f.frame()


def sensitive_tables(source: Catalog, scope: DataFrame) -> DataFrame:
    """(database, table, four counts) of tables whose values may be shown in more than one way."""
    kind = F.lower("data_type")
    counts = {"approximate": kind.isin("float", "double"), "temporal": kind.isin("timestamp", "datetime"), "json": kind == "json", "collated": F.col("collation").isNotNull()}
    found = within(source.columns, scope).groupBy("database", "table").agg(*(F.count_if(c).alias(n) for n, c in counts.items()))
    return found.filter(" or ".join(f"{n} > 0" for n in counts)).orderBy("database", "table")


def data_shape(source: Catalog, dest: Catalog, include=(), exclude=()) -> DataFrame:
    """Tables without a stable key, and tables whose hashes may be noisy."""
    f, scope = Findings("data-shape", source), _scope(source, include, exclude)
    if scope.isEmpty():
        f.tell("data_shape_no_selected_databases", "info", "No database is in scope.", "Check the filters.")
        return f.frame()
    bare, noisy = keyless_tables(source, scope), sensitive_tables(source, scope)
    f.summed(bare, "stable_key_required_tables_detected", "error", "tables have no stable key", "Add a primary key or a unique key without nulls.")
    f.each(bare, "stable_key_required_table", "error", _place("database", "table"))
    f.summed(noisy, "representation_sensitive_tables_detected", "warn", "tables may hash differently for equal values", "Review samples where hashes differ.")
    f.each(noisy, "representation_sensitive_table", "warn", _place("database", "table"))
    f.clean("data_shape_inventory_clean", "Every table has a stable key and plain values.")
    return f.frame()


def grants_hold(grants: DataFrame, privilege: str) -> bool:
    """Does any grant give everything, or this privilege?"""
    g = F.upper("grant")
    return bool(grants.agg(F.bool_or(g.contains("ALL PRIVILEGES") | g.contains(privilege)).alias("has")).first()["has"])


def manual_evidence(source: Catalog, dest: Catalog, include=(), exclude=(), *, views: bool = True, grants: DataFrame | None = None) -> DataFrame:
    """What people must rehearse or review; ``grants`` (grant) are those of the account in use."""
    f, a, b = Findings("manual-evidence", source), source.instance(), dest.instance()
    f.tell("backup_restore_rehearsal_required", "warn", "Restore a backup before the move.", "Keep the record.")
    f.tell("metadata_lock_runbook_required", "warn", "Have a runbook for metadata locks.", "Keep the record.")
    f.tell("replication_transaction_shape_rehearsal_required", "warn", "Rehearse replication with the transactions you have.", "Keep the record.")
    if (a["engine"], a["version"]) != (b["engine"], b["version"]):
        f.tell("dump_tool_skew_review_required", "warn", "Tools of one version may not read the other.", "Review the versions of tools.")
    if views:
        f.tell("view_definer_rewrite_review_required", "warn", "Definers of views are rewritten.", "Review security contexts.")
    if grants is None:
        f.tell("source_current_user_grants_unavailable", "warn", "Own grants cannot be read.", "Check privileges by hand.")
        return f.frame()
    f.tell("source_current_user_grants_recorded", "info", "Own grants were read.", "Keep the record.")
    for privileges, code in ((("REPLICATION CLIENT",), "replication_client_privilege_missing"), (("REPLICATION SLAVE", "REPLICATION REPLICA"), "replication_stream_privilege_missing")):
        if not any(grants_hold(grants, p) for p in privileges):
            f.tell(code, "warn", f"{privileges[0]} is not granted.", "Grant it.")
    return f.frame()


CHECKS = {
    "zero-date": zero_dates, "plugin-lifecycle": plugins, "invisible-gipk": invisible, "collation": collations, "schema-feature": schema_features, "identifier-portability": identifiers,
    "foreign-key-cycle": foreign_key_cycles, "replication-boundary": replication_boundary, "replication-readiness": replication_readiness, "timezone-portability": time_zones, "data-shape": data_shape, "manual-evidence": manual_evidence,
}
BEFORE_SCHEMA = ("plugin-lifecycle", "invisible-gipk", "collation", "zero-date", "schema-feature", "identifier-portability")


def plan(source: Catalog, dest: Catalog, include=(), exclude=(), checks: tuple[str, ...] = tuple(CHECKS)) -> DataFrame:
    """All findings of the checks named."""
    return reduce(DataFrame.unionByName, (CHECKS[c](source, dest, include, exclude) for c in checks))


def incompatible(findings: DataFrame) -> bool:
    return not findings.filter("severity = 'error'").isEmpty()
