"""Queries of the column functions over made-up values, with results worked out by hand."""

from __future__ import annotations

from pyspark.sql import types as T
from pyspark.sql import functions as F

from ..functions import canonical, text
from .golden import rows


def over(values, schema: str, **columns):
    """A query that applies columns to made-up rows."""
    def run(spark, sf_dir: str):
        df = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)
        return df.select(*df.columns, *(c(F.col).alias(n) for n, c in columns.items()))

    return run


def canonical_query(spark, sf_dir: str):
    """One value of each type as it is hashed."""
    import datetime as dt
    from decimal import Decimal

    field = lambda n, t, kind=None: T.StructField(n, t, True, {"mysql_type": kind} if kind else {})
    schema = T.StructType([field("n", T.IntegerType()), field("i", T.LongType()), field("b", T.BooleanType()), field("d", T.DecimalType(10, 4)), field("f", T.DoubleType()), field("tiny", T.DoubleType()), field("huge", T.DoubleType()), field("blob", T.BinaryType()), field("txt", T.BinaryType(), "text"), field("js", T.StringType(), "json"), field("num", T.StringType(), "json"), field("like", T.StringType(), "longtext"), field("broken", T.StringType(), "json"), field("scalar", T.StringType(), "varchar"), field("ts", T.TimestampType()), field("wall", T.TimestampNTZType()), field("day", T.DateType())])
    one = (None, -7, True, Decimal("1.5000"), 12345678.25, 0.00001, 1e21, b"abc", b"abc", '{"b": 1, "a": [2, "x"]}', " 5 ", ' [1, {"z":1,"y":2}] ', "{no", "5", dt.datetime(2024, 1, 2, 3, 4, 5, 120000, dt.UTC), dt.datetime(2024, 1, 2), dt.date(2024, 1, 2))
    df = spark.createDataFrame([one], schema)
    pairs = F.array(*(F.struct(F.lit(f.name).alias("name"), canonical.value(F.col(f.name), f).alias("shown")) for f in df.schema.fields))
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def pair_query(spark, sf_dir: str):
    """The same rows from two engines: other key order in JSON, other integer widths, another time type."""
    import datetime as dt

    a = spark.createDataFrame([(1, '{"a":1,"b":2}', dt.datetime(2024, 1, 2, tzinfo=dt.UTC))], T.StructType([T.StructField("id", T.IntegerType()), T.StructField("js", T.StringType(), True, {"mysql_type": "json"}), T.StructField("at", T.TimestampType())]))
    b = spark.createDataFrame([(1, ' {"b":2, "a":1} ', dt.datetime(2024, 1, 2))], T.StructType([T.StructField("id", T.LongType()), T.StructField("js", T.StringType(), True, {"mysql_type": "longtext"}), T.StructField("at", T.TimestampNTZType())]))
    return a.select(canonical.row_digest(a).alias("d")).join(b.select(canonical.row_digest(b).alias("e"))).select((F.col("d") == F.col("e")).alias("same"))


STATEMENTS = ["CREATE  TABLE `T` (`a` INT DEFAULT 'X  y') AUTO_INCREMENT = 12 ;", "create definer=`r`@`%` view V as\n select 'It\\'s' , \"Q\"", "select 1"]
CODE = ["SELECT a -- \"x\"\nFROM b", "SELECT 'it' || \"c\" /* || */ # end", "SELECT a--1, `shop`.t FROM `shop`.u WHERE x = '`shop`.z'", "SELECT \"open"]

QUERIES = {
    "identifier_quote": over([("a", "b`c"), ("", "x")], "s string, t string", quoted=lambda c: text.quoted(c("t")), qualified=lambda c: text.qualified(c("s"), c("t")), key=lambda c: text.table_key(c("s"), F.upper("t"))),
    "text_literal": over(["it's", "a\\b", ""], "v string", shown=lambda c: text.literal(c("v")), who=lambda c: text.account(c("v"), F.lit("%"))),
    "statement_normal": over(STATEMENTS, "sql string", normal=lambda c: text.normal_statement(c("sql")), folded=lambda c: text.folded_outside_quotes(c("sql"))),
    "statement_code": over(CODE, "sql string", code=lambda c: text.code_only(c("sql")), moved=lambda c: text.moved_to(c("sql"), F.lit("shop"), F.lit("s2"))),
    "statement_definer": over(["CREATE DEFINER = `a`@`b` VIEW v", "CREATE DEFINER='a'@'b' VIEW v"], "sql string", own=lambda c: text.own_definer(c("sql"))),
    "mixed_case": over(["Users", "users", "USERS", "Été1", "é1"], "name string", mixed=lambda c: text.mixed_case(c("name"))),
    "sandbox_name": over(["My-App 1", "__", "ok_2", "x" * 70], "name string", plain=lambda c: text.plain_name(c("name")), sandbox=lambda c: text.sandbox_name("k3", c("name"))),
    "trigger_name": over(["users", "t" * 44, "t" * 45], "name string", trigger=lambda c: text.trigger_name("insert", c("name"))),
    "fnv_hash": over(["", "a", "foobar", "é"], "v string", h=lambda c: text.fnv1a32(c("v"))),
    "base36": over([0, 35, 36, 1704067200], "n long", shown=lambda c: text.base36(c("n"))),
    "sample_redact": over(["id=1", "created_at=2024-01-02 03:04:05", "name:a->b", "... +3 more", "plain", "a=b:c"], "v string", shown=lambda c: text.redacted(c("v"))),
    "list_parse": over([" a, b ,,c", "", " , "], "v string", items=lambda c: F.array_join(text.listed(c("v")), "|")),
    "log_file_names": over(["", "bin.000001", "a..b", "../x", "a/b", "a b", "ü-1.9", "x" * 256], "name string", bare=lambda c: text.bare_file(c("name"))),
    "log_position_order": over([("bin.000009", 5, "bin.000010", 4), ("bin.9", 5, "bin.000010", 4), ("bin.000010", 4, "bin.000010", 5), ("plain", 1, "plain", 1), ("bin.000002", 1, "log.000001", 1)], "f string, p long, g string, r long", before=lambda c: text.position(c("f"), c("p")) < text.position(c("g"), c("r")), same=lambda c: text.position(c("f"), c("p")) == text.position(c("g"), c("r"))),
    "collation_aliases": over([" UCA1400_AI_CI", "utf8mb4_uca1400_as_cs", "utf8mb4_bin"], "v string", names=lambda c: F.array_join(text.collation_names(c("v")), "|")),
    "account_class": over(["mysql.sys", "ROOT", "app", "healthcheck"], "u string", kind=lambda c: text.account_class(c("u"))),
    "strict_zero_date": over(["STRICT_TRANS_TABLES,NO_ZERO_DATE", " strict_all_tables , no_zero_in_date", "NO_ZERO_DATE", "STRICT_TRANS_TABLES", "MY_STRICT_TRANS_TABLES,NO_ZERO_DATE"], "m string", strict=lambda c: text.refuses_zero_dates(c("m"))),
    "zero_date_defaults": over(["'0000-00-00'", "2024-00-15 00:00:00", "2024-01-00T00:00", "2024-01-15", "CURRENT_TIMESTAMP", "", None, "0000-1-1"], "v string", zero=lambda c: text.zero_date(c("v"))),
    "log_ddl_classify": over(["CREATE VIEW v AS SELECT 1", "CREATE OR REPLACE VIEW v AS SELECT 1", "create table t (id int)", "ALTER TABLE t ADD c int", "ALTER TABLE t ADD c int, DROP d", "ALTER TABLE t DROP address", "ALTER TABLE t RENAME TO u", "ALTER TABLE t ENGINE=InnoDB", "DROP TABLE t", "truncate t", "INSERT INTO t VALUES (1)", " "], "sql string", kind=lambda c: text.ddl_class(c("sql"))),
    "switches": over(["1", "on", " TRUE ", "0", "OFF", "maybe", None], "v string", state=lambda c: text.switched_on(c("v"))),
    "unsigned_numbers": over(["0", " 4294967295 ", "4294967296", "-1", "x", "1.5"], "v string", n=lambda c: text.unsigned32(c("v"))),
    "timezone_effective": over([("SYSTEM", "CET"), (" +00:00 ", "CET"), ("system", " UTC")], "z string, s string", zone=lambda c: text.effective_zone(c("z"), c("s"))),
    "lag_seconds": over([(100, 40), (40, 100), (7, 7)], "a long, b long", lag=lambda c: text.lag_seconds(c("a"), c("b"))),
    "version_parse": over([" 8.4.3 ", "11.4.2-MariaDB-log", "5.5.5-10.6.1-MARIADB", "eight", ""], "raw string", **{k: (lambda c, k=k: text.version(c("raw"))[k]) for k in ("engine", "major", "minor", "patch", "parsed", "version")}),
    "version_at_least": over(["8.0.23", "8.0.22", "9.0.0", "7.9.99"], "raw string", ok=lambda c: text.at_least(text.version(c("raw")), 8, 0, 23)),
    "event_bytes": over([("f", "s", "t", "q", [["ab", None], []]), (None, None, None, None, None)], "f string, s string, t string, q string, r array<array<string>>", size=lambda c: text.event_bytes(*(c(x) for x in "fstqr"))),
    "canonical_values": canonical_query,
    "canonical_pair": pair_query,
}
QUERIES["event_bytes"] = (lambda f: lambda spark, sf_dir: f(spark, sf_dir).select("f", "size"))(QUERIES["event_bytes"])

SQL = {
    "identifier_quote": rows("s, t, quoted, qualified, key", ("a", "b`c", "`b``c`", "`a`.`b``c`", "a.b`c"), ("", "x", "`x`", "``.`x`", ".x")),
    "text_literal": rows("v, shown, who", ("it's", "'it\\'s'", "'it\\'s'@'%'"), ("a\\b", "'a\\\\b'", "'a\\\\b'@'%'"), ("", "''", "''@'%'")),
    "statement_normal": rows("sql, normal, folded",
        (STATEMENTS[0], "create table T (a int default 'X y') auto_increment=?", "create  table `T` (`a` int default 'X  y') auto_increment = 12 ;"),
        (STATEMENTS[1], "create definer=? view v as select 'It\\'s' , \"Q\"", "create definer=`r`@`%` view v as\n select 'It\\'s' , \"Q\""), (STATEMENTS[2], "select 1", "select 1")),
    "statement_code": rows("sql, code, moved", (CODE[0], "SELECT a \nFROM b", CODE[0]), (CODE[1], "SELECT  || \"\"  ", CODE[1]), (CODE[2], "SELECT a--1, `shop`.t FROM `shop`.u WHERE x = ", "SELECT a--1, `s2`.t FROM `s2`.u WHERE x = '`shop`.z'"), (CODE[3], "SELECT \"", CODE[3])),
    "statement_definer": rows("sql, own", ("CREATE DEFINER = `a`@`b` VIEW v", "CREATE DEFINER=CURRENT_USER VIEW v"), ("CREATE DEFINER='a'@'b' VIEW v", "CREATE DEFINER='a'@'b' VIEW v")),
    "mixed_case": rows("name, mixed", ("Users", True), ("users", False), ("USERS", False), ("Été1", True), ("é1", False)),
    "sandbox_name": rows("name, plain, sandbox", ("My-App 1", "my_app_1", "ferryline_dr_k3_my_app_1"), ("__", "", "ferryline_dr_k3_db"), ("ok_2", "ok_2", "ferryline_dr_k3_ok_2"), ("x" * 70, "x" * 70, "ferryline_dr_k3_" + "x" * 39 + "_77f3c97d")),
    "trigger_name": rows("name, trigger", ("users", "__ferryline_insert_users"), ("t" * 44, "__ferryline_insert_" + "t" * 44), ("t" * 45, "__ferryline_insert_" + "t" * 45)),
    "fnv_hash": rows("v, h BIGINT", ("", 2166136261), ("a", 0xE40C292C), ("foobar", 0xBF9CF968), ("é", 513665217)),
    "base36": rows("n BIGINT, shown", (0, "0"), (35, "z"), (36, "10"), (1704067200, "s6k2o0")),
    "sample_redact": rows("v, shown", ("id=1", "id=<redacted>"), ("created_at=2024-01-02 03:04:05", "created_at=<redacted>"), ("name:a->b", "name:<redacted>"), ("... +3 more", "... +3 more"), ("plain", "<redacted>"), ("a=b:c", "a=<redacted>")),
    "list_parse": rows("v, items", (" a, b ,,c", "a|b|c"), ("", ""), (" , ", "")),
    "log_file_names": rows("name, bare", ("", True), ("bin.000001", True), ("a..b", False), ("../x", False), ("a/b", False), ("a b", False), ("ü-1.9", True), ("x" * 256, False)),
    "log_position_order": rows("f, p BIGINT, g, r BIGINT, before, same", ("bin.000009", 5, "bin.000010", 4, True, False), ("bin.9", 5, "bin.000010", 4, True, False), ("bin.000010", 4, "bin.000010", 5, True, False), ("plain", 1, "plain", 1, False, True), ("bin.000002", 1, "log.000001", 1, True, False)),
    "collation_aliases": rows("v, names", (" UCA1400_AI_CI", "uca1400_ai_ci|utf8mb4_uca1400_ai_ci"), ("utf8mb4_uca1400_as_cs", "utf8mb4_uca1400_as_cs|uca1400_as_cs"), ("utf8mb4_bin", "utf8mb4_bin")),
    "account_class": rows("u, kind", ("mysql.sys", "system"), ("ROOT", "administrative"), ("app", "user-managed"), ("healthcheck", "administrative")),
    "strict_zero_date": rows("m, strict", ("STRICT_TRANS_TABLES,NO_ZERO_DATE", True), (" strict_all_tables , no_zero_in_date", True), ("NO_ZERO_DATE", False), ("STRICT_TRANS_TABLES", False), ("MY_STRICT_TRANS_TABLES,NO_ZERO_DATE", False)),
    "zero_date_defaults": rows("v, zero", ("'0000-00-00'", True), ("2024-00-15 00:00:00", True), ("2024-01-00T00:00", True), ("2024-01-15", False), ("CURRENT_TIMESTAMP", False), ("", False), (None, False), ("0000-1-1", False)),
    "log_ddl_classify": rows("sql, kind", ("CREATE VIEW v AS SELECT 1", "safe"), ("CREATE OR REPLACE VIEW v AS SELECT 1", "risky"), ("create table t (id int)", "safe"), ("ALTER TABLE t ADD c int", "safe"), ("ALTER TABLE t ADD c int, DROP d", "risky"), ("ALTER TABLE t DROP address", "risky"), ("ALTER TABLE t RENAME TO u", "risky"), ("ALTER TABLE t ENGINE=InnoDB", "risky"), ("DROP TABLE t", "risky"), ("truncate t", "risky"), ("INSERT INTO t VALUES (1)", None), (" ", None)),
    "switches": rows("v, state", ("1", True), ("on", True), (" TRUE ", True), ("0", False), ("OFF", False), ("maybe", None), (None, None)),
    "unsigned_numbers": rows("v, n BIGINT", ("0", 0), (" 4294967295 ", 4294967295), ("4294967296", None), ("-1", None), ("x", None), ("1.5", None)),
    "timezone_effective": rows("z, s, zone", ("SYSTEM", "CET", "CET"), (" +00:00 ", "CET", "+00:00"), ("system", " UTC", "UTC")),
    "lag_seconds": rows("a BIGINT, b BIGINT, lag BIGINT", (100, 40, 60), (40, 100, 0), (7, 7, 0)),
    "version_parse": rows("raw, engine, major INTEGER, minor INTEGER, patch INTEGER, parsed, version", (" 8.4.3 ", "mysql", 8, 4, 3, True, "8.4.3"), ("11.4.2-MariaDB-log", "mariadb", 11, 4, 2, True, "11.4.2"), ("5.5.5-10.6.1-MARIADB", "mariadb", 5, 5, 5, True, "5.5.5"), ("eight", "mysql", None, None, None, False, ""), ("", "unknown", None, None, None, False, "")),
    "version_at_least": rows("raw, ok", ("8.0.23", True), ("8.0.22", False), ("9.0.0", True), ("7.9.99", False)),
    "event_bytes": rows("f, size BIGINT", ("f", 96 + 4 + 24 + 2 + 8 + 24), (None, 96)),
    "canonical_values": rows("name, shown", ("n", "null:"), ("i", "int64:-7"), ("b", "bool:true"), ("d", "string:1.5000"), ("f", "float64:12345678.25"), ("tiny", "float64:1e-05"), ("huge", "float64:1e+21"), ("blob", "bytes:YWJj"), ("txt", "string:abc"), ("js", 'json:{"a":[2,"x"],"b":1}'), ("num", "json:5"), ("like", 'json:[1,{"y":2,"z":1}]'), ("broken", "string:{no"), ("scalar", "string:5"), ("ts", "time:2024-01-02T03:04:05.12Z"), ("wall", "time:2024-01-02T00:00:00Z"), ("day", "time:2024-01-02T00:00:00Z")),
    "canonical_pair": rows("same", (True,)),
}
