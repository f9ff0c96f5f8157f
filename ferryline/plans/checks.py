"""Queries over catalog frames of two made-up servers; what they must find is worked out by hand from the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog as cat
from ..operators import compat, graph, objects, prechecks, schema_diff, triggerlog, verify
from ..operators.catalog import Catalog
from .golden import rows

T = "BASE TABLE"
VERSIONED = "CREATE TABLE `audit` (`id` int) WITH SYSTEM VERSIONING"
SOURCE = {
    "databases": [("shop", "utf8mb4_0900_ai_ci"), ("crm", "utf8mb4_bin"), ("CRM", "utf8mb4_bin"), ("mysql", ""), ("sys", "")],
    "tables": [
        ("shop", "users", T, "InnoDB", "utf8mb4_0900_ai_ci", ""), ("shop", "orders", T, "MyISAM", "utf8mb4_bin", ""), ("shop", "Log", T, "Aria", "utf8mb4_bin", ""), ("shop", "log", "VIEW", None, None, ""),
        ("shop", "rank", T, "InnoDB", "utf8mb4_bin", ""), ("crm", "a", T, "InnoDB", "utf8mb4_bin", VERSIONED), ("crm", "b", T, "InnoDB", "utf8mb4_bin", ""), ("crm", "c", T, "InnoDB", "utf8mb4_bin", ""), ("mysql", "user", T, "InnoDB", "utf8mb4_bin", ""),
    ],
    "columns": [
        ("shop", "users", "id", 1, "int", "int unsigned", "NO", None, "auto_increment", None, None, "PRI"), ("shop", "users", "prefs", 2, "JSON", "json", "YES", None, "", None, None, ""),
        ("shop", "users", "born", 3, "date", "date", "YES", "0000-00-00", "", None, None, ""), ("shop", "users", "name", 4, "varchar", "varchar(40)", "YES", None, "", "utf8mb4", "utf8mb4_0900_ai_ci", ""), ("shop", "users", "secret", 5, "int", "int", "YES", None, "INVISIBLE", None, None, ""),
        ("shop", "orders", "id", 1, "int", "int", "NO", None, "", None, None, "PRI"), ("shop", "orders", "made", 2, "timestamp", "timestamp", "NO", "2024-00-15 00:00:00", "", None, None, ""), ("shop", "orders", "paid", 3, "datetime", "datetime", "YES", "2024-01-15 10:00:00", "", None, None, ""), ("shop", "orders", "user_id", 4, "int", "int", "YES", None, "", None, None, "MUL"),
        ("shop", "Log", "msg", 1, "text", "text", "YES", None, "", "utf8mb4", "utf8mb4_uca1400_ai_ci", ""), ("shop", "Log", "score", 2, "double", "double", "YES", None, "", None, None, ""), ("shop", "rank", "my_row_id", 1, "bigint", "bigint unsigned", "NO", None, "auto_increment INVISIBLE", None, None, "PRI"), ("shop", "rank", "system", 2, "int", "int", "YES", None, "", None, None, ""),
        ("crm", "a", "id", 1, "int", "int", "NO", None, "", None, None, "PRI"), ("crm", "a", "b_id", 2, "int", "int", "YES", None, "", None, None, ""), ("crm", "b", "id", 1, "int", "int", "NO", None, "", None, None, "PRI"), ("crm", "c", "at", 1, "timestamp", "timestamp", "NO", None, "", None, None, ""),
    ],
    "index_parts": [
        ("shop", "users", "PRIMARY", 0, 1, "id", "BTREE", "YES"), ("shop", "users", "u_born", 0, 1, "born", "BTREE", "NO"), ("shop", "orders", "b_two", 0, 1, "id", "BTREE", "YES"), ("shop", "orders", "b_two", 0, 2, "made", "BTREE", "YES"), ("shop", "orders", "a_open", 0, 1, "paid", "BTREE", "YES"), ("shop", "Log", "i_msg", 1, 1, "msg", "FULLTEXT", "YES"),
        ("shop", "rank", "PRIMARY", 0, 1, "my_row_id", "BTREE", "YES"), ("crm", "a", "PRIMARY", 0, 1, "id", "BTREE", "YES"), ("crm", "b", "PRIMARY", 0, 1, "id", "BTREE", "YES"),
    ],
    "fk_parts": [("shop", "orders", "f_user", 1, "user_id", None, "users", "id", "RESTRICT", "CASCADE"), ("crm", "a", "f_ab", 1, "b_id", "crm", "b", "id", "NO ACTION", "SET NULL"), ("crm", "b", "f_ba", 1, "id", "crm", "a", "id", "RESTRICT", "RESTRICT"), ("crm", "b", "f_bb", 1, "id", "crm", "b", "id", "RESTRICT", "RESTRICT"), ("crm", "c", "f_cb", 1, "at", "crm", "b", "id", "RESTRICT", "RESTRICT"), ("crm", "c", "f_out", 1, "at", "shop", "users", "id", "RESTRICT", "RESTRICT")],
    "partitions": [("shop", "Log", "p0", "RANGE", "score", "100", 1), ("shop", "Log", "p1", "RANGE", "score", "200", 2)],
    "objects": [
        ("shop", "table", "users", "CREATE TABLE `users` (`id` int) AUTO_INCREMENT=17"), ("shop", "table", "orders", "CREATE TABLE `orders` (`id` int, `note` varchar(9) DEFAULT 'Ab')"), ("shop", "table", "rank", "CREATE TABLE `rank` (`my_row_id` int)"),
        ("shop", "view", "v_quoted", "CREATE DEFINER=`root`@`localhost` VIEW `v_quoted` AS SELECT \"a\" FROM `shop`.`users`"), ("shop", "view", "v_pipes", "CREATE VIEW `v_pipes` AS SELECT a || b FROM `shop`.`users` -- \"no\""), ("shop", "view", "v_plain", "CREATE VIEW `v_plain` AS SELECT '||\"' AS x"), ("shop", "procedure", "p_one", "CREATE PROCEDURE p_one() SELECT 1"),
    ],
    "accounts": [("root", "localhost", "caching_sha2_password", "CREATE USER 'root'@'localhost'", ["GRANT ALL PRIVILEGES ON *.* TO 'root'@'localhost'"]), ("app", "%", "mysql_native_password", " CREATE USER 'app'@'%' ", ["GRANT USAGE ON *.* TO 'app'@'%'", "GRANT SELECT ON `shop`.* TO 'app'@'%'", "GRANT INSERT ON `shop`.* TO 'app'@'%'"]), ("old", "%", "mysql_old_password", "CREATE USER 'old'@'%'", []), ("x.session", "%", "p", "CREATE USER 'x.session'@'%'", [])],
    "settings": [("version", "8.4.3"), ("sql_mode", "ANSI_QUOTES,STRICT_TRANS_TABLES"), ("lower_case_table_names", "0"), ("log_bin", "ON"), ("binlog_format", "MIXED"), ("binlog_row_image", "MINIMAL"), ("binlog_row_value_options", "PARTIAL_JSON"), ("gtid_mode", "ON"), ("time_zone", "SYSTEM"), ("system_time_zone", "CET"), ("collation_server", "utf8mb4_0900_ai_ci"), ("show_gipk_in_create_table_and_information_schema", "OFF")],
    "triggers": [("shop", "users", "__ferryline_insert_users"), ("shop", "users", "__ferryline_update_users"), ("shop", "users", "__ferryline_delete_users"), ("shop", "orders", "__ferryline_update_orders")],
}
DEST = {
    "databases": [("shop", "utf8mb4_general_ci")],
    "tables": [("shop", "users", T, "InnoDB", "utf8mb4_bin", ""), ("shop", "orders", T, "InnoDB", "utf8mb4_bin", ""), ("shop", "Log", T, "InnoDB", "utf8mb4_bin", "")],
    "columns": [("shop", "users", "id", 1, "bigint", "bigint", "NO", None, "", None, None, "PRI"), ("shop", "users", "born", 2, "date", "DATE", "YES", "0000-00-00", "", None, None, ""), ("shop", "users", "extra", 3, "int", "int", "YES", None, "", None, None, ""), ("shop", "orders", "id", 1, "int", "int", "NO", None, "", None, None, "PRI")],
    "index_parts": [("shop", "users", "PRIMARY", 0, 1, "id", "BTREE", "YES"), ("shop", "orders", "b_two", 0, 1, "made", "BTREE", "YES"), ("shop", "orders", "b_two", 0, 2, "id", "BTREE", "YES"), ("shop", "orders", "a_open", 1, 1, "paid", "BTREE", "YES"), ("shop", "orders", "z_new", 1, 1, "paid", "BTREE", "YES")],
    "fk_parts": [("shop", "orders", "f_user", 1, "user_id", None, "users", "id", "RESTRICT", "SET NULL")],
    "partitions": [("shop", "Log", "p0", "RANGE", "score", "100", 1), ("shop", "Log", "p1", "RANGE", "score", "300", 2), ("shop", "Log", "p2", "RANGE", "score", "400", 3)],
    "objects": [("shop", "table", "users", "create table users (`id`   INT)  AUTO_INCREMENT = 99;"), ("shop", "table", "orders", "CREATE TABLE `orders` (`id` int, `note` varchar(9) DEFAULT 'ab')"), ("shop", "view", "v_quoted", "CREATE DEFINER=`app`@`%` VIEW `v_quoted` AS SELECT \"a\" FROM `shop`.`users`"), ("shop", "view", "v_new", "CREATE VIEW v_new AS SELECT 1")],
    "plugins": [("caching_sha2_password", "ACTIVE", "AUTHENTICATION"), ("mysql_native_password", "DISABLED", "AUTHENTICATION")],
    "engines": [("InnoDB", "DEFAULT"), ("MyISAM", "NO")],
    "collations": [("utf8mb4_bin",), ("utf8mb4_general_ci",), ("uca1400_ai_ci",)],
    "keywords": [("RANK", 1), ("SYSTEM", 1), ("NAME", 0)],
    "settings": [("version", "11.4.2-MariaDB"), ("sql_mode", "STRICT_TRANS_TABLES,NO_ZERO_DATE,PIPES_AS_CONCAT"), ("lower_case_table_names", "1"), ("time_zone", "+00:00"), ("collation_server", "utf8mb4_uca1400_ai_ci")],
}
#: The source as the other engine would be, for what only that engine has.
OTHER = SOURCE | {"sequences": [("shop", "s_one")], "settings": [("version", "10.11.6-MariaDB")]}
QUIET = {"databases": [("shop", "utf8mb4_bin")], "tables": [("shop", "t", T, "InnoDB", "utf8mb4_bin", "")], "columns": [("shop", "t", "id", 1, "int", "int", "NO", None, "", None, None, "PRI")], "index_parts": [("shop", "t", "PRIMARY", 0, 1, "id", "BTREE", "YES")], "accounts": [("app", "%", "p", "CREATE USER 'app'@'%'", [])], "plugins": [("p", "ACTIVE", "AUTHENTICATION")], "engines": [("InnoDB", "YES")], "collations": [("utf8mb4_bin",)], "keywords": [("SELECT", 1)], "settings": [("version", "8.4.3"), ("sql_mode", "NO_ENGINE_SUBSTITUTION"), ("default_authentication_plugin", "p"), ("lower_case_table_names", "0"), ("log_bin", "ON"), ("binlog_format", "ROW"), ("binlog_row_image", "FULL"), ("binlog_file", "b.000001"), ("time_zone", "+00:00")]}


def server(spark, facts: dict) -> Catalog:
    frames = {n: spark.createDataFrame(v, ", ".join(f"`{c.rpartition(' ')[0]}` {c.rpartition(' ')[2]}" for c in cat.FRAMES[n].split(", "))) for n, v in facts.items()}
    return Catalog(spark, **frames)


def on(make, a=SOURCE, b=DEST):
    """A query from a function of (source, dest)."""
    return lambda spark, sf_dir: make(server(spark, a), server(spark, b))


def check(name: str, a=SOURCE, b=DEST, **options):
    """A check's findings, counted by code and severity."""
    return on(lambda s, d: prechecks.CHECKS[name](s, d, **options).groupBy("code", "severity").agg(F.count("*").alias("n")), a, b)


def told(*found: tuple) -> str:
    return rows("code, severity, n BIGINT", *found)


def scope(c: Catalog) -> DataFrame:
    return cat.selected(c.databases)


def arrays_as_text(df: DataFrame) -> DataFrame:
    return df.select(*(F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes))


PAIRS = [
    ("8.4.3", "8.4.5", "strict-lts", 0), ("8.4.5", "8.4.3", "", 2), ("8.4.0", "8.0.36", "strict-lts", 0), ("11.8.2-MariaDB", "11.4.2-MariaDB", "strict-lts", 0), ("8.4.3", "11.4.2-MariaDB", "strict-lts", 0), ("8.4.3", "10.11.6-MariaDB", "unheard-of", 0), ("8.0.36", "11.4.2-MariaDB", "strict-lts", 0),
    ("8.4.3", "11.4.2-MariaDB", "same-major", 0), ("11.8.2-MariaDB", "11.4.2-MariaDB", "same-major", 0), ("11.4.2-MariaDB", "10.11.6-MariaDB", "same-major", 0), ("8.4.3", "8.0.36", "same-major", 0), ("11.8.2-MariaDB", "11.4.2-MariaDB", "adjacent-minor", 0), ("11.5.2-MariaDB", "11.4.2-MariaDB", "adjacent-minor", 0),
    ("8.4.3", "11.8.2-MariaDB", "max-compat", 0), ("8.4.3", "11.8.2-MariaDB", "max-compat", 3), ("8.4.3", "11.4.2-MariaDB", "max-compat", 0), ("8.0.36", "11.4.2-MariaDB", "max-compat", 0), ("8.0.36", "8.0.30", "max-compat", 0), ("eight", "8.4.3", "strict-lts", 0), ("", "8.4.3", "max-compat", 0),
]


def evaluated(spark, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame([(i, *p) for i, p in enumerate(PAIRS)], "pair int, source string, dest string, profile string, selected_databases int")
    found = compat.evaluate(pairs)
    return found.select("pair", "compatible", "downgrade", "requires_evidence", "downgrade_profile", F.array_join(F.transform("findings", lambda f: F.concat(f["code"], F.lit(":"), f["severity"])), ",").alias("findings"))


def _verdicts() -> str:
    p, legacy = "downgrade_profile_selected:info", "max_compat_legacy_line:warn"
    none, ok, cross, down = "no_downgrade_detected:info", "downgrade_allowed_by_profile:info", "cross_engine_path:warn", "downgrade_detected:warn"
    bad = "version_or_engine_unparseable:error"
    found = [
        (True, False, False, "strict-lts", p, none), (True, True, False, "strict-lts", p, "partial_database_scope:info", down, "strict_lts_matrix_match:info", ok), (False, True, False, "strict-lts", p, down, "strict_lts_matrix_out_of_range:error"),
        (False, True, False, "strict-lts", p, down, "strict_lts_matrix_mismatch:error"), (True, False, False, "strict-lts", p, cross, "strict_lts_cross_engine_matrix_match:info", none), (False, False, False, "strict-lts", p, cross, "strict_lts_cross_engine_matrix_mismatch:error"),
        (False, False, False, "strict-lts", p, cross, "strict_lts_cross_engine_out_of_range:error"), (False, False, False, "same-major", p, cross, "profile_same_engine_only:error"), (True, True, False, "same-major", p, down, "same_major_matrix_match:info", ok), (False, True, False, "same-major", p, down, "downgrade_major_mismatch:error"),
        (False, True, False, "same-major", p, down, "same_major_matrix_out_of_range:error"), (False, True, False, "adjacent-minor", p, down, "downgrade_minor_gap:error"), (True, True, False, "adjacent-minor", p, down, "adjacent_minor_matrix_match:info", ok),
        (True, False, True, "max-compat", p, cross, "cross_engine_matrix_candidate_unconfirmed:warn", "cross_engine_matrix_candidate_validation_required:warn", "cross_engine_matrix_candidate_partial_scope_recommended:info", none),
        (True, False, True, "max-compat", p, "partial_database_scope:info", cross, "cross_engine_matrix_candidate_unconfirmed:warn", "cross_engine_matrix_candidate_validation_required:warn", "cross_engine_matrix_candidate_partial_scope_active:info", none),
        (True, False, False, "max-compat", p, cross, "cross_engine_matrix_mapped:info", none), (True, False, False, "max-compat", p, cross, "cross_engine_matrix_unmapped:warn", none), (True, True, False, "max-compat", p, down, "max_compat_profile:warn", legacy, legacy, ok),
        (False, False, False, "strict-lts", p, bad), (False, False, False, "max-compat", p, bad),
    ]
    return rows("pair INTEGER, compatible, downgrade, requires_evidence, downgrade_profile, findings", *((i, *f[:4], ",".join(f[4:])) for i, f in enumerate(found)))


def order_query(spark, sf_dir: str) -> DataFrame:
    """Copy order of a longer graph: a chain of twelve, a cycle, and what hangs on it."""
    tables = [f"t{i:02d}" for i in range(12)] + ["x", "y", "z"]
    links = [(f"t{i:02d}", f"t{i + 1:02d}") for i in range(11)] + [("x", "y"), ("y", "x"), ("z", "x")]
    order, unplaced = graph.copy_order(tables, links)
    return spark.createDataFrame([(i, t, t in unplaced) for i, t in enumerate(order)], "place int, name string, unplaced boolean")


def long_reach(spark, sf_dir: str) -> DataFrame:
    links = spark.createDataFrame([("d", f"t{i:02d}", f"t{i + 1:02d}") for i in range(30)] + [("d", "t30", "t00")], "database string, `table` string, needs string")
    return graph.cycles(links).select("database", F.size("tables").alias("size"))


S = lambda make: on(lambda s, d: arrays_as_text(make(s, scope(s))))
QUERIES = {
    "scope_select": on(lambda s, d: cat.selected(s.databases, [" Shop ", "crm"], ["CRM"])),
    "scope_select_all": on(lambda s, d: cat.selected(s.databases)),
    "scope_capture": on(lambda s, d: cat.selected_for_capture(s.databases, ["shop", "CRM"], [])),
    "base_tables": S(cat.base_tables),
    "column_listing": on(lambda s, d: cat.column_list(s).filter("database = 'shop' and `table` = 'users'").select("column", "ordinal", "data_type")),
    "stable_key": S(lambda s, sc: cat.stable_keys(s)),
    "keyless_tables": S(cat.keyless_tables),
    "replay_keys": S(lambda s, sc: cat.within(cat.replay_keys(s), sc).filter("database = 'crm'")),
    "destination_table_counts": on(lambda s, d: cat.table_counts(s, ["crm"])),
    "part_differences": on(lambda s, d: schema_diff.part_differences(s, d).select("kind", "table", "object_name")),
    "part_definitions": on(lambda s, d: schema_diff.part_differences(s, d).filter("kind like '%definition_mismatch'").select("kind", "object_name", "source_def", "dest_def")),
    "object_differences": on(lambda s, d: schema_diff.object_differences(s.objects, d.objects).select("kind", "object_type", "object_name")),
    "fk_edges": S(lambda s, sc: graph.edges(s, sc)),
    "fk_cycles": S(lambda s, sc: graph.cycles(graph.edges(s, sc))),
    "fk_cycle_downstream": S(lambda s, sc: graph.in_or_behind_cycles(graph.edges(s, sc))),
    "fk_long_cycle": long_reach,
    "copy_order": order_query,
    "compat_findings": evaluated,
    "zero_date_script": S(lambda s, sc: prechecks.fix_script(s, sc)),
    "collations_unsupported": on(lambda s, d: prechecks.unsupported_collations(s, d, scope(s)).select("scope", "table", "column", "collation")),
    "reserved_identifiers": on(lambda s, d: prechecks.reserved_identifiers(s, d, scope(s)).select("object_type", "identifier", "destination_only")),
    "case_collisions": S(prechecks.case_collisions),
    "engine_gap": on(lambda s, d: prechecks.unsupported_engines(s, d, scope(s)).select("table", "engine", "support")),
    "auth_plugin_gap": on(lambda s, d: prechecks.unsupported_accounts(s, d)),
    "schema_statements": S(lambda s, sc: objects.schema_statements(s, sc, ("table", "view", "procedure")).filter("database = 'shop'").select("place", "object_type", "name")),
    "schema_rehearsal": S(lambda s, sc: objects.schema_statements(s, sc, ("view",), "r1").filter("name like 'v_p%' or object_type = 'database'").select("name", "statement")),
    "account_statements": on(lambda s, d: objects.account_statements(s)),
    "account_counters": on(lambda s, d: objects.account_counts(s)),
    "missing_triggers": S(lambda s, sc: triggerlog.missing_triggers(s, sc).filter("database = 'shop' and `table` in ('users', 'orders')")),
    "trigger_statements": S(lambda s, sc: triggerlog.setup_statements(s, sc).filter("`table` = 'b'").select("event", "statement")),
    "trigger_teardown": S(lambda s, sc: triggerlog.teardown_statements(s, sc).groupBy("database").agg(F.count("*").alias("n"), F.max_by("statement", "statement").alias("last"))),
    "primary_key_parts": lambda spark, sf_dir: cat.primary_key_parts(spark.createDataFrame([("d", "t", "PRIMARY", "PRIMARY KEY"), ("d", "t", "u", "UNIQUE")], "database string, `table` string, `constraint` string, constraint_type string"), spark.createDataFrame([("d", "t", "PRIMARY", "b", "10"), ("d", "t", "PRIMARY", "a", "9"), ("d", "t", "u", "c", "1"), ("e", "t", "PRIMARY", "x", "1")], "database string, `table` string, `constraint` string, `column` string, ordinal string")),
    "fk_parts": lambda spark, sf_dir: cat.fk_parts_of(spark.createDataFrame([("d", "t", "f", "CASCADE", "SET NULL"), ("d", "s", "g", "CASCADE", "CASCADE")], "database string, `table` string, `constraint` string, update_rule string, delete_rule string"), spark.createDataFrame([("d", "t", "f", "a", 1, "d", "p", "id"), ("d", "t", "f", "b", 2, "d", "p", "no"), ("d", "t", "PRIMARY", "a", 1, None, None, None)], "database string, `table` string, `constraint` string, `column` string, ordinal int, ref_database string, ref_table string, ref_column string")).select("constraint", "ordinal", "column", "ref_table", "ref_column", "update_rule", "delete_rule"),
    "settings_row": on(lambda s, d: cat.settings_row(s, "Version", "log_bin", "nothing")),
    "representation_risk": on(lambda s, d: prechecks.sensitive_tables(s, scope(s)).drop("database")),
    "verify_noise_risk": on(lambda s, d: verify.table_risks(s.columns.select("database", "table", "data_type", "collation")).drop("database").withColumn("notes", F.size("notes"))),
    "timezone_mix": on(lambda s, d: prechecks.temporal_tables(s, scope(s)).drop("database")),
    "union_of_databases": on(lambda s, d: verify.union_of_names(s.databases.select("database"), d.databases.select(F.concat(F.lit(" "), "database", F.lit(" "))), d.databases.select(F.lit(" ")))),
    "destination_empty": on(lambda s, d: s.spark.createDataFrame([("source", objects.destination_empty(s)), ("nothing", objects.destination_empty(Catalog(s.spark))), ("excluded", objects.destination_empty(d, ["shop"]))], "name string, empty boolean")),
    "precheck_zero_date": check("zero-date"),
    "precheck_plugins": check("plugin-lifecycle"),
    "precheck_invisible": check("invisible-gipk"),
    "precheck_collation": check("collation"),
    "precheck_schema_feature": check("schema-feature"),
    "precheck_schema_feature_other": check("schema-feature", OTHER, SOURCE),
    "precheck_identifiers": check("identifier-portability"),
    "precheck_fk_cycles": check("foreign-key-cycle"),
    "precheck_boundary": check("replication-boundary"),
    "precheck_readiness": check("replication-readiness"),
    "precheck_time_zones": check("timezone-portability"),
    "precheck_data_shape": check("data-shape"),
    "precheck_manual_evidence": on(lambda s, d: prechecks.manual_evidence(s, d, grants=s.accounts.select(F.explode("grants").alias("grant")).filter("grant like '%app%'")).groupBy("code", "severity").agg(F.count("*").alias("n"))),
    "precheck_empty_scope": on(lambda s, d: prechecks.plan(s, d, ["nowhere"], checks=("plugin-lifecycle", "invisible-gipk", "collation", "schema-feature", "identifier-portability", "timezone-portability", "data-shape")).filter("code like '%no_selected%'").groupBy("code", "severity").agg(F.count("*").alias("n"))),
    "precheck_clean": on(lambda s, d: prechecks.plan(s, d).groupBy("code", "severity").agg(F.count("*").alias("n")), QUIET, QUIET),
}
SQL = {
    "scope_select": rows("database", ("shop",)),
    "scope_select_all": rows("database", ("CRM",), ("crm",), ("shop",)),
    "scope_capture": rows("database", ("shop",), ("crm",), ("CRM",)),
    "base_tables": rows('"database", "table"', ("crm", "a"), ("crm", "b"), ("crm", "c"), ("shop", "Log"), ("shop", "orders"), ("shop", "rank"), ("shop", "users")),
    "column_listing": rows('"column", ordinal INTEGER, data_type', ("id", 1, "int"), ("prefs", 2, "json"), ("born", 3, "date"), ("name", 4, "varchar"), ("secret", 5, "int")),
    "stable_key": rows('"database", "table", "index", columns', ("shop", "users", "PRIMARY", "id"), ("shop", "orders", "b_two", "id,made"), ("shop", "rank", "PRIMARY", "my_row_id"), ("crm", "a", "PRIMARY", "id"), ("crm", "b", "PRIMARY", "id")),
    "keyless_tables": rows('"database", "table"', ("crm", "c"), ("shop", "Log")),
    "replay_keys": rows('"database", "table", columns, has_foreign_keys', ("crm", "a", "id", True), ("crm", "b", "id", True), ("crm", "c", "", True)),
    "destination_table_counts": rows('"database", tables BIGINT', ("shop", 5)),
    "part_differences": rows('kind, "table", object_name',
        ("column_definition_mismatch", "users", "id"), ("column_missing_in_destination", "users", "prefs"), ("column_missing_in_destination", "users", "name"), ("column_missing_in_destination", "users", "secret"), ("column_extra_in_destination", "users", "extra"),
        ("column_missing_in_destination", "orders", "made"), ("column_missing_in_destination", "orders", "paid"), ("column_missing_in_destination", "orders", "user_id"), ("column_missing_in_destination", "Log", "msg"), ("column_missing_in_destination", "Log", "score"),
        ("index_missing_in_destination", "users", "u_born"), ("index_definition_mismatch", "orders", "b_two"), ("index_definition_mismatch", "orders", "a_open"), ("index_extra_in_destination", "orders", "z_new"), ("index_missing_in_destination", "Log", "i_msg"),
        ("fk_definition_mismatch", "orders", "f_user"), ("partition_definition_mismatch", "Log", "p1"), ("partition_extra_in_destination", "Log", "p2")),
    "part_definitions": rows("kind, object_name, source_def, dest_def",
        ("column_definition_mismatch", "id", "int unsigned nullable=NO extra=auto_increment", "bigint nullable=NO"), ("index_definition_mismatch", "b_two", "type=btree unique=unique cols=id,made", "type=btree unique=unique cols=made,id"),
        ("index_definition_mismatch", "a_open", "type=btree unique=unique cols=paid", "type=btree unique=non_unique cols=paid"), ("fk_definition_mismatch", "f_user", "ref=users(id) on_update=RESTRICT on_delete=CASCADE cols=user_id", "ref=users(id) on_update=RESTRICT on_delete=SET NULL cols=user_id"),
        ("partition_definition_mismatch", "p1", "method=RANGE expr=score desc=200 pos=2", "method=RANGE expr=score desc=300 pos=2")),
    "object_differences": rows("kind, object_type, object_name", ("definition_mismatch", "table", "orders"), ("missing_in_destination", "table", "rank"), ("missing_in_destination", "view", "v_pipes"), ("missing_in_destination", "view", "v_plain"), ("missing_in_source", "view", "v_new"), ("missing_in_destination", "procedure", "p_one")),
    "fk_edges": rows('"database", "table", needs', ("shop", "orders", "users"), ("crm", "a", "b"), ("crm", "b", "a"), ("crm", "c", "b")),
    "fk_cycles": rows('"database", tables', ("crm", "a,b")),
    "fk_cycle_downstream": rows('"database", "table"', ("crm", "a"), ("crm", "b"), ("crm", "c")),
    "fk_long_cycle": rows('"database", size INTEGER', ("d", 31)),
    "copy_order": rows("place INTEGER, name, unplaced", *((i, f"t{11 - i:02d}", False) for i in range(12)), (12, "x", True), (13, "y", True), (14, "z", True)),
    "compat_findings": _verdicts(),
    "zero_date_script": rows("fix", ("ALTER TABLE `shop`.`orders` ALTER COLUMN `made` SET DEFAULT '1970-01-01 00:00:01';",), ("ALTER TABLE `shop`.`users` ALTER COLUMN `born` SET DEFAULT '1970-01-01';",)),
    "collations_unsupported": rows('scope, "table", "column", collation', ("schema", "", "", "utf8mb4_0900_ai_ci"), ("table", "users", "", "utf8mb4_0900_ai_ci"), ("column", "users", "name", "utf8mb4_0900_ai_ci")),
    "reserved_identifiers": rows("object_type, identifier, destination_only", ("table", "rank", False), ("column", "system", False)),
    "case_collisions": rows('"database", object_type, folded_name, objects', ("", "database", "crm", "CRM,crm"), ("shop", "table/view", "log", "Log,log")),
    "engine_gap": rows('"table", engine, support', ("orders", "MyISAM", "NO"), ("Log", "Aria", "MISSING")),
    "auth_plugin_gap": rows('"user", host, plugin, account_class', ("app", "%", "mysql_native_password", "user-managed"), ("old", "%", "mysql_old_password", "user-managed"), ("x.session", "%", "p", "user-managed")),
    "schema_statements": rows("place INTEGER, object_type, name", (1, "database", "shop"), (2, "table", "rank"), (3, "table", "users"), (4, "table", "orders"), (5, "view", "v_pipes"), (6, "view", "v_plain"), (7, "view", "v_quoted"), (8, "procedure", "p_one")),
    "schema_rehearsal": rows("name, statement", ("ferryline_dr_r1_shop", "CREATE DATABASE IF NOT EXISTS `ferryline_dr_r1_shop`"), ("ferryline_dr_r1_crm", "CREATE DATABASE IF NOT EXISTS `ferryline_dr_r1_crm`"), ("ferryline_dr_r1_crm", "CREATE DATABASE IF NOT EXISTS `ferryline_dr_r1_crm`"), ("v_pipes", "CREATE VIEW `v_pipes` AS SELECT a || b FROM `ferryline_dr_r1_shop`.`users` -- \"no\""), ("v_plain", "CREATE VIEW `v_plain` AS SELECT '||\"' AS x")),
    "account_statements": rows('"user", host, place INTEGER, statement',
        ("app", "%", 0, "CREATE USER 'app'@'%'"), ("app", "%", 1, "GRANT INSERT ON `shop`.* TO 'app'@'%'"), ("app", "%", 2, "GRANT SELECT ON `shop`.* TO 'app'@'%'"), ("app", "%", 3, "FLUSH PRIVILEGES"), ("old", "%", 0, "CREATE USER 'old'@'%'"), ("old", "%", 1, "FLUSH PRIVILEGES")),
    "account_counters": rows("seen BIGINT, skipped BIGINT, copied BIGINT", (4, 2, 2)),
    "missing_triggers": rows('"database", "table", "trigger"', ("shop", "orders", "__ferryline_delete_orders"), ("shop", "orders", "__ferryline_insert_orders")),
    "trigger_statements": rows("event, statement",
        ("insert", "CREATE TRIGGER `__ferryline_insert_b` AFTER INSERT ON `crm`.`b` FOR EACH ROW INSERT INTO `crm`.`__ferryline_change_log` (table_name, operation, old_row_json, new_row_json) VALUES ('b', 'insert', NULL, JSON_OBJECT('id', NEW.`id`))"),
        ("update", "CREATE TRIGGER `__ferryline_update_b` AFTER UPDATE ON `crm`.`b` FOR EACH ROW INSERT INTO `crm`.`__ferryline_change_log` (table_name, operation, old_row_json, new_row_json) VALUES ('b', 'update', JSON_OBJECT('id', OLD.`id`), JSON_OBJECT('id', NEW.`id`))"),
        ("delete", "CREATE TRIGGER `__ferryline_delete_b` AFTER DELETE ON `crm`.`b` FOR EACH ROW INSERT INTO `crm`.`__ferryline_change_log` (table_name, operation, old_row_json, new_row_json) VALUES ('b', 'delete', JSON_OBJECT('id', OLD.`id`), NULL)")),
    "trigger_teardown": rows('"database", n BIGINT, "last"', ("crm", 10, "DROP TRIGGER IF EXISTS `crm`.`__ferryline_update_c`"), ("shop", 13, "DROP TRIGGER IF EXISTS `shop`.`__ferryline_update_users`")),
    "primary_key_parts": rows('"database", "table", "column", ordinal INTEGER', ("d", "t", "a", 9), ("d", "t", "b", 10)),
    "fk_parts": rows('"constraint", ordinal INTEGER, "column", ref_table, ref_column, update_rule, delete_rule', ("f", 1, "a", "p", "id", "CASCADE", "SET NULL"), ("f", 2, "b", "p", "no", "CASCADE", "SET NULL")),
    "settings_row": rows("Version, log_bin, nothing VARCHAR", ("8.4.3", "ON", None)),
    "representation_risk": rows('"table", approximate BIGINT, temporal BIGINT, "json" BIGINT, collated BIGINT', ("users", 0, 0, 1, 1), ("orders", 0, 2, 0, 0), ("Log", 1, 0, 0, 1), ("c", 0, 1, 0, 0)),
    "verify_noise_risk": rows('"table", approximate_numeric_columns BIGINT, temporal_columns BIGINT, json_columns BIGINT, collation_sensitive_columns BIGINT, notes INTEGER', ("users", 0, 1, 1, 1, 3), ("orders", 0, 2, 0, 0, 1), ("Log", 1, 0, 0, 1, 2), ("c", 0, 1, 0, 0, 1)),
    "timezone_mix": rows('"table", timestamps BIGINT, datetimes BIGINT', ("orders", 1, 1), ("c", 1, 0)),
    "union_of_databases": rows("name", ("CRM",), ("crm",), ("mysql",), ("shop",), ("sys",)),
    "destination_empty": rows("name, empty", ("source", False), ("nothing", True), ("excluded", True)),
    "precheck_zero_date": told(("zero_date_defaults_incompatible", "error", 1), ("zero_date_default_column", "error", 2)),
    "precheck_plugins": told(("destination_no_engine_substitution_disabled", "warn", 1), ("destination_default_auth_plugin_variable_unavailable", "warn", 1), ("unsupported_auth_plugins_detected", "warn", 1), ("unsupported_auth_plugin_account", "warn", 3), ("unsupported_storage_engines_detected", "error", 1), ("unsupported_storage_engine_table", "error", 2)),
    "precheck_invisible": told(("source_show_gipk_disabled", "warn", 1), ("invisible_gipk_features_detected", "error", 1), ("invisible_column_detected", "error", 1), ("invisible_index_detected", "error", 1), ("generated_invisible_primary_key_detected", "error", 1)),
    "precheck_collation": told(("unsupported_destination_collations_detected", "error", 1), ("unsupported_destination_collation", "error", 3), ("client_collation_compatibility_risk_detected", "warn", 1), ("client_collation_compatibility_risk", "warn", 2)),
    "precheck_schema_feature": told(("cross_engine_json_columns_detected", "error", 1), ("cross_engine_json_column", "error", 1)),
    "precheck_schema_feature_other": told(("cross_engine_json_columns_detected", "error", 1), ("cross_engine_json_column", "error", 1), ("mariadb_sequences_unsupported_on_destination", "error", 1), ("mariadb_sequence_object", "error", 1), ("system_versioned_tables_unsupported_on_destination", "error", 1), ("system_versioned_table", "error", 1)),
    "precheck_identifiers": told(("source_reserved_word_inventory_fallback", "warn", 1), ("lower_case_table_names_inventory_recorded", "info", 1), ("lower_case_table_names_mismatch", "error", 1), ("case_fold_collisions_detected", "error", 1), ("case_fold_collision", "error", 2), ("mixed_case_identifiers_detected", "error", 1), ("mixed_case_identifier", "error", 1), ("destination_reserved_identifiers_warn_only", "warn", 1), ("destination_reserved_identifier_warn_only", "warn", 2), ("view_parser_drift_detected", "error", 1), ("view_parser_drift_risk", "error", 2)),
    "precheck_fk_cycles": told(("foreign_key_cycles_detected", "error", 1), ("foreign_key_cycle_group", "error", 1)),
    "precheck_boundary": told(("cross_engine_gtid_boundary_detected", "warn", 1), ("cross_engine_gtid_state_inventory_recorded", "warn", 1), ("cross_engine_replication_non_row_binlog_format", "warn", 1), ("mysql_to_mariadb_binlog_row_value_options_set", "warn", 1)),
    "precheck_readiness": told(("replication_readiness_master_status_unavailable", "warn", 1), ("replication_readiness_non_row_binlog_format", "warn", 1), ("replication_readiness_non_full_row_image", "warn", 1), ("replication_readiness_cross_engine_lane", "warn", 1)),
    "precheck_time_zones": told(("timezone_inventory_recorded", "info", 1), ("timezone_environment_drift_detected", "warn", 1), ("mixed_timestamp_datetime_tables_detected", "warn", 1), ("mixed_timestamp_datetime_table", "warn", 1), ("timestamp_table_timezone_review", "warn", 1)),
    "precheck_data_shape": told(("stable_key_required_tables_detected", "error", 1), ("stable_key_required_table", "error", 2), ("representation_sensitive_tables_detected", "warn", 1), ("representation_sensitive_table", "warn", 4)),
    "precheck_manual_evidence": told(("backup_restore_rehearsal_required", "warn", 1), ("metadata_lock_runbook_required", "warn", 1), ("replication_transaction_shape_rehearsal_required", "warn", 1), ("dump_tool_skew_review_required", "warn", 1), ("view_definer_rewrite_review_required", "warn", 1), ("source_current_user_grants_recorded", "info", 1), ("replication_client_privilege_missing", "warn", 1), ("replication_stream_privilege_missing", "warn", 1)),
    "precheck_empty_scope": told(*((f"{n}_no_selected_databases", "info", 1) for n in ("plugin_lifecycle", "invisible_gipk", "collation_precheck", "schema_feature", "identifier_portability", "timezone_portability", "data_shape"))),
    "precheck_clean": told(*((c, "info", 1) for c in ("plugin_lifecycle_inventory_clean", "invisible_gipk_inventory_clean", "collation_inventory_clean", "schema_feature_inventory_clean", "lower_case_table_names_inventory_recorded", "identifier_portability_inventory_clean", "foreign_key_cycle_inventory_clean", "replication_boundary_same_engine_inventory_skipped", "replication_readiness_binary_log_status_recorded", "timezone_inventory_recorded", "timezone_temporal_inventory_clean", "data_shape_inventory_clean")), *((c, "warn", 1) for c in ("backup_restore_rehearsal_required", "metadata_lock_runbook_required", "replication_transaction_shape_rehearsal_required", "view_definer_rewrite_review_required", "source_current_user_grants_unavailable"))),
}
