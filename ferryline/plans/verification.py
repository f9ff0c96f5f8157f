"""Queries that compare two sides of data tables; the second side of each is derived by a fixed rule.

Spark runs the frames of ``operators.verify``; the checking engine has SQL of its own, written from the definition of the digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import copying, verify

TABLES = {
    "region": ("r_regionkey", ["r_regionkey int", "r_name text"]),
    "nation": ("n_nationkey", ["n_nationkey int", "n_name text", "n_regionkey int"]),
    "customer": ("c_custkey", ["c_custkey int", "c_name text", "c_nationkey int", "c_acctbal real", "c_mktsegment text"]),
    "supplier": ("s_suppkey", ["s_suppkey int", "s_name text", "s_nationkey int", "s_acctbal real"]),
    "part": ("p_partkey", ["p_partkey int", "p_name text", "p_brand text", "p_type text", "p_size int", "p_retailprice real"]),
    "orders": ("o_orderkey", ["o_orderkey int", "o_custkey int", "o_orderstatus text", "o_totalprice real", "o_orderdate time", "o_orderpriority text"]),
}
CHANGED = {"region": "r_name", "nation": "n_name", "customer": "c_name", "supplier": "s_name", "part": "p_name", "orders": "o_orderstatus"}
DB = "tpch"


def source(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*(c.split()[0] for c in TABLES[table][1]))


def dest(spark, sf_dir: str, table: str) -> DataFrame:
    """Some keys are missing, a column is changed or null for others, and some rows have keys of their own."""
    key, col = TABLES[table][0], CHANGED[table]
    df = source(spark, sf_dir, table)
    k = F.col(key)
    changed = F.when(k % 83 == 0, F.lit(None)).when(k % 89 == 1, F.concat(col, F.lit("<~>"))).otherwise(F.col(col))
    kept = df.filter(k % 97 != 3).withColumn(col, changed)
    own = df.filter(k % 101 == 0).withColumn(key, (k + 10_000_000).cast(df.schema[key].dataType))
    return kept.unionByName(own)


def both(spark, sf_dir: str, names=tuple(TABLES)):
    return {(DB, t): source(spark, sf_dir, t) for t in names}, {(DB, t): dest(spark, sf_dir, t) for t in names}


KEYS = {(DB, t): [k] for t, (k, _) in TABLES.items()}


def column_rows(spark) -> DataFrame:
    """What a catalog would say of the columns, for the notes."""
    kinds = {"int": "int", "text": "varchar", "real": "double", "time": "datetime"}
    rows = [(DB, t, c.split()[0], kinds[c.split()[1]], "utf8mb4_bin" if c.endswith("text") else None) for t, (_, cols) in TABLES.items() for c in cols]
    return spark.createDataFrame(rows, "database string, `table` string, `column` string, data_type string, collation string")


def compared(mode: str, names=tuple(TABLES)):
    def run(spark, sf_dir: str) -> DataFrame:
        a, b = both(spark, sf_dir, names)
        found = verify.verify(spark, a, b, mode, keys=KEYS, risks=verify.table_risks(column_rows(spark)))
        return found.withColumn("notes", F.size("notes")) if "notes" in found.columns else found

    return run


def digests(mode: str, side: int = 0, names=tuple(TABLES)):
    return lambda spark, sf_dir: verify.digests(spark, both(spark, sf_dir, names)[side], KEYS, mode)


def full_hash(table: str):
    def run(spark, sf_dir: str) -> DataFrame:
        a, b = both(spark, sf_dir, (table,))
        one = lambda x, name: verify.digests(spark, x, KEYS, "full-hash").select("table", F.col("digest").alias(name))
        found = one(a, "source_hash").join(one(b, "dest_hash"), "table")
        return found.select(F.col("table").alias("table_name"), "source_hash", "dest_hash", F.when(F.col("source_hash") == F.col("dest_hash"), "match").otherwise("hash_mismatch").alias("kind"))

    return run


def summary(spark, sf_dir: str) -> DataFrame:
    a, b = both(spark, sf_dir)
    a.pop((DB, "part"))
    b.pop((DB, "nation"))
    left, right = verify.digests(spark, a, KEYS, "hash"), verify.digests(spark, b, KEYS, "hash")
    return verify.summary(left, right, verify.digest_differences(left, right, verify.table_risks(column_rows(spark))))


def counted_pair(spark, sf_dir: str) -> DataFrame:
    a, b = both(spark, sf_dir)
    a.pop((DB, "part"))
    b.pop((DB, "nation"))
    return verify.verify(spark, a, b, "count")


def chunk_query(spark, sf_dir: str) -> DataFrame:
    found = copying.chunk_ledger(source(spark, sf_dir, "orders"), ["o_orderkey"], 1000)
    return found.select("chunk", F.col("first.o_orderkey").alias("first_key"), F.col("last.o_orderkey").alias("last_key"), "rows")


# ---- the same for the checking engine


def _tagged(column: str) -> str:
    name, kind = column.split()
    shown = {"int": f"'int64:' || CAST({name} AS VARCHAR)", "text": f"'string:' || {name}", "real": f"'float64:' || regexp_replace(CAST({name} AS VARCHAR), '\\.0$', '')", "time": f"'time:' || strftime({name}, '%Y-%m-%dT%H:%M:%SZ')"}[kind]
    return f"coalesce({shown}, 'null:')"


def side_sql(table: str, side: int) -> str:
    key, columns = TABLES[table]
    names = [c.split()[0] for c in columns]
    if not side:
        return f"SELECT {', '.join(names)} FROM {table}"
    col = CHANGED[table]
    picked = ", ".join(f"CASE WHEN {key} % 83 = 0 THEN NULL WHEN {key} % 89 = 1 THEN {col} || '<~>' ELSE {col} END AS {col}" if n == col else n for n in names)
    own = ", ".join(f"{n} + 10000000 AS {n}" if n == key else n for n in names)
    return f"SELECT {picked} FROM {table} WHERE {key} % 97 <> 3 UNION ALL SELECT {own} FROM {table} WHERE {key} % 101 = 0"


def digest_sql(table: str, side: int, mode: str) -> str:
    key, columns = TABLES[table]
    row = f"CAST(to_json([{', '.join(map(_tagged, columns))}]) AS VARCHAR)"
    for sign in "<>&":
        row = f"replace({row}, '{sign}', '\\u{ord(sign):04x}')"
    rows = f"(SELECT row_number() OVER (ORDER BY {key}) AS rn, sha256({row}) AS d FROM ({side_sql(table, side)}))"
    if mode == "sample":
        return f"(SELECT sha256(string_agg('r:' || d || chr(10), '' ORDER BY rn) || 'mode:sample rows:' || count(*) || chr(10)) FROM {rows} WHERE rn <= 1000)"
    size, lead = (2000, "r:") if mode == "hash" else (500, "")
    chunks = f"(SELECT (rn - 1) // {size} AS c, count(*) AS n, sha256(string_agg('{lead}' || d || chr(10), '' ORDER BY rn)) AS d FROM {rows} GROUP BY 1)"
    books = f"(SELECT c // 4096 AS b, sum(n) AS n, count(*) AS c, sha256(string_agg('chunk:' || c || ' rows:' || n || ' digest:' || d || chr(10), '' ORDER BY c)) AS d FROM {chunks} GROUP BY 1)"
    return f"(SELECT sha256(string_agg(d || chr(10), '' ORDER BY b) || 'mode:{mode} rows:' || sum(n) || ' chunks:' || sum(c) || chr(10)) FROM {books})"


def digests_sql(mode: str, side: int = 0, names=tuple(TABLES)) -> str:
    return " UNION ALL ".join(f"SELECT '{DB}' AS \"database\", '{t}' AS \"table\", {digest_sql(t, side, mode)} AS digest" for t in names)


def notes_sql(t: str) -> int:
    kinds = [c.split()[1] for c in TABLES[t][1]]
    return ("real" in kinds) + ("time" in kinds) + ("text" in kinds)


def compared_sql(mode: str, names=tuple(TABLES)) -> str:
    each = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", {digest_sql(t, 0, mode)} AS source_hash, {digest_sql(t, 1, mode)} AS dest_hash, {notes_sql(t)} AS notes" for t in names)
    return f"SELECT 'table_hash_mismatch' AS kind, '{DB}' AS \"database\", \"table\", source_hash, dest_hash, CASE WHEN notes > 0 THEN 'representation_sensitive' ELSE '' END AS noise_risk, notes FROM ({each}) WHERE source_hash <> dest_hash"


def full_hash_sql(t: str) -> str:
    return f"SELECT '{t}' AS table_name, s AS source_hash, d AS dest_hash, CASE WHEN s = d THEN 'match' ELSE 'hash_mismatch' END AS kind FROM (SELECT {digest_sql(t, 0, 'full-hash')} AS s, {digest_sql(t, 1, 'full-hash')} AS d)"


def counts_sql() -> str:
    n = lambda t, side: f"(SELECT count(*) FROM ({side_sql(t, side)}))"
    rows = []
    for t in TABLES:
        a, b = ("0" if t == "part" else n(t, 0)), ("0" if t == "nation" else n(t, 1))
        kind = "'missing_in_source'" if t == "part" else "'missing_in_destination'" if t == "nation" else f"CASE WHEN {a} <> {b} THEN 'row_count_mismatch' END"
        rows.append(f"SELECT {kind} AS kind, '{DB}' AS \"database\", '{t}' AS \"table\", CAST({a} AS BIGINT) AS source_count, CAST({b} AS BIGINT) AS dest_count")
    return f"SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE kind IS NOT NULL"


def summary_sql() -> str:
    here = [t for t in TABLES if t not in ("part", "nation")]
    differ = " + ".join(f"CASE WHEN {digest_sql(t, 0, 'hash')} <> {digest_sql(t, 1, 'hash')} THEN 1 ELSE 0 END" for t in here)
    return f"SELECT {len(here)} AS compared_tables, 1 AS missing_in_destination, 1 AS missing_in_source, 0 AS count_mismatches, n AS hash_mismatches, n AS noise_risk_mismatches FROM (SELECT {differ} AS n)"


SMALL = ("region", "nation", "customer", "supplier", "part")
QUERIES = {
    "verify_count_differences": counted_pair,
    "verify_hash_digests": digests("hash"),
    "verify_hash_digests_dest": digests("hash", 1, SMALL),
    "verify_sample_digests": digests("sample"),
    "verify_full_hash_digests": digests("full-hash", 0, SMALL),
    "verify_hash": compared("hash"),
    "verify_sample": compared("sample", SMALL),
    "verify_full_hash": compared("full-hash", SMALL),
    "verify_summary": summary,
    "chunk_ledger": chunk_query,
    **{f"verify_full_hash_{t}": full_hash(t) for t in TABLES},
}
SQL = {
    "verify_count_differences": counts_sql(),
    "verify_hash_digests": digests_sql("hash"),
    "verify_hash_digests_dest": digests_sql("hash", 1, SMALL),
    "verify_sample_digests": digests_sql("sample"),
    "verify_full_hash_digests": digests_sql("full-hash", 0, SMALL),
    "verify_hash": compared_sql("hash"),
    "verify_sample": compared_sql("sample", SMALL),
    "verify_full_hash": compared_sql("full-hash", SMALL),
    "verify_summary": summary_sql(),
    "chunk_ledger": "SELECT c AS chunk, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(*) AS rows FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS c FROM orders) GROUP BY c",
    **{f"verify_full_hash_{t}": full_hash_sql(t) for t in TABLES},
}
