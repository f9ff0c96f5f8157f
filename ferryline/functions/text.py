"""Column functions on names, statements and settings, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME_LIMIT = 64
LOG_TABLE, TRIGGER_PREFIX, SANDBOX_PREFIX = "__ferryline_change_log", "__ferryline_", "ferryline_dr_"

# Tokens of a statement: comments, quoted runs (an open one reaches the end), and single other characters or runs of them.
_COMMENT = r"#[^\n]*|--(?=[ \t\n])[^\n]*|/\*(?:.(?!\*/))*+(?:.?\*/)?"
_TOKEN = r"(?s)" + _COMMENT + r"""|'[^']*+'?|"[^"]*+"?|[^'"#/-]+|."""


def quoted(name: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def qualified(schema: Column, table: Column) -> Column:
    return F.concat_ws(".", quoted(schema), quoted(table))


def table_key(schema: Column, table: Column) -> Column:
    """How tables are told apart in routes and exclusions: lower case, joined by a dot."""
    return F.concat_ws(".", F.lower(schema), F.lower(table))


def literal(text: Column) -> Column:
    """A string literal: backslashes are doubled, then quotes escaped."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("'"), escaped, F.lit("'"))


def account(user: Column, host: Column) -> Column:
    return F.concat_ws("@", literal(user), literal(host))


def fnv1a32(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, as an unsigned 32-bit number in a long."""
    digits = F.hex(F.encode(text, "UTF-8"))
    n = (F.length(digits) / 2).cast("int")
    places = F.filter(F.sequence(F.lit(0), n), lambda i: i < n)
    byte = lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    step = lambda h, i: (h.bitwiseXOR(byte(i)) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(places, F.lit(2166136261).cast("long"), step)


def hash_suffix(text: Column) -> Column:
    return F.lpad(F.lower(F.hex(fnv1a32(text))), 8, "0")


def base36(number: Column) -> Column:
    return F.lower(F.conv(number.cast("string"), 10, 36))


def trigger_name(event: str, table: Column) -> Column:
    """The name of a capture trigger, at most 64 characters; a longer one keeps the start of the table and its eight-digit hash."""
    lead = f"{TRIGGER_PREFIX}{event}_"
    room = max(1, NAME_LIMIT - len(lead) - 8)
    full = F.concat(F.lit(lead), table)
    return F.when(F.octet_length(full) <= NAME_LIMIT, full).otherwise(F.concat(F.lit(lead), F.substring(table, 1, room), hash_suffix(table)))


def plain_name(name: Column) -> Column:
    """Lower case; anything but a-z, 0-9 and _ becomes _; none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9_]", "_"), F.lit("_"))


def sandbox_name(run_id: str, database: Column) -> Column:
    """The database that a rehearsal run uses for ``database``, at most 64 characters."""
    plain = F.coalesce(F.nullif(plain_name(database), F.lit("")), F.lit("db"))
    lead = f"{SANDBOX_PREFIX}{run_id}_"
    room = max(1, NAME_LIMIT - len(lead) - 9)
    full = F.concat(F.lit(lead), plain)
    return F.when(F.length(full) <= NAME_LIMIT, full).otherwise(F.concat(F.lit(lead), F.substring(plain, 1, room), F.lit("_"), hash_suffix(database)))


def folded_outside_quotes(sql: Column) -> Column:
    """Lower case outside '...', "..." and `...` (backslash escapes)."""
    token = r"""(?s)'(?:\\.|[^'\\])*+'?|"(?:\\.|[^"\\])*+"?|`(?:\\.|[^`\\])*+`?|[^'"`]+"""
    return F.array_join(F.transform(F.regexp_extract_all(sql, F.lit(token), F.lit(0)), lambda t: F.when(t.rlike("^['\"`]"), t).otherwise(F.lower(t))), "")


def normal_statement(sql: Column) -> Column:
    """A CREATE statement as it is compared: no closing semicolon, definer or counter, single blanks, folded outside quotes, no backticks."""
    out = F.regexp_replace(F.trim(sql), r";$", "")
    out = F.regexp_replace(out, r"(?i)\bDEFINER\s*=\s*`[^`]+`@`[^`]+`", "DEFINER=?")
    out = F.regexp_replace(out, r"(?i)\bAUTO_INCREMENT\s*=\s*\d+\b", "AUTO_INCREMENT=?")
    out = folded_outside_quotes(F.trim(F.regexp_replace(out, r"\s+", " ")))
    return F.replace(out, F.lit("`"), F.lit(""))


def code_only(sql: Column) -> Column:
    """The statement without comments and without what is inside strings; of "..." the quotes stay."""
    def shown(t):
        dropped = t.rlike(r"^(#|--[ \t\n]|--$|/\*)") | t.startswith("'")
        return F.when(t.startswith('"'), F.when(F.length(t) > 1, F.when(t.endswith('"'), '""').otherwise('"')).otherwise('"')).when(dropped, "").otherwise(t)

    return F.array_join(F.transform(F.regexp_extract_all(sql, F.lit(_TOKEN), F.lit(0)), shown), "")


def moved_to(sql: Column, database: Column, target: Column) -> Column:
    """References to `database`. become references to `target`., but not in strings or comments."""
    lead, by = F.concat(quoted(database), F.lit(".")), F.concat(quoted(target), F.lit("."))
    keep = lambda t: t.rlike(r"^(#|--[ \t\n]|/\*|['\"])")
    return F.array_join(F.transform(F.regexp_extract_all(sql, F.lit(_TOKEN), F.lit(0)), lambda t: F.when(keep(t), t).otherwise(F.replace(t, lead, by))), "")


def own_definer(sql: Column) -> Column:
    return F.regexp_replace(sql, r"(?i)\bDEFINER\s*=\s*`[^`]+`@`[^`]+`", "DEFINER=CURRENT_USER")


def mixed_case(name: Column) -> Column:
    return name.rlike(r"\p{Lu}") & name.rlike(r"\p{Ll}")


def shown_value(value: Column) -> Column:
    """A value in a report: NULL, line breaks as blanks, cut after 80 bytes."""
    flat = F.translate(value.cast("string"), "\n\r", "  ")
    cut = F.decode(F.substring(F.encode(flat, "UTF-8"), F.lit(1), F.lit(80)), "UTF-8")
    return F.coalesce(F.when(F.octet_length(flat) <= 80, flat).otherwise(F.concat(cut, F.lit("..."))), F.lit("NULL"))


def value_sample(names: Column, values: Column, most: int = 6) -> Column:
    """``name=value`` of the first six, then how many more there are."""
    shown = F.transform(F.slice(values, 1, most), lambda v, i: F.concat(F.coalesce(F.nullif(F.trim(F.get(names, i)), F.lit("")), F.concat(F.lit("v"), (i + 1).cast("string"))), F.lit("="), shown_value(v)))
    return _with_rest(shown, F.size(values) - most, " more")


def difference_sample(names: Column, old: Column, new: Column, most: int = 6) -> Column:
    """``name:old->new`` of the first six values that differ as shown, then how many more changes there are."""
    def change(pair, i):
        a, b = shown_value(pair["a"]), shown_value(pair["b"])
        label = F.coalesce(F.nullif(F.trim(F.get(names, i)), F.lit("")), F.concat(F.lit("v"), (i + 1).cast("string")))
        return F.when(a != b, F.concat(label, F.lit(":"), a, F.lit("->"), b))

    both = F.least(F.size(old), F.size(new))
    pairs = F.zip_with(F.slice(old, F.lit(1), both), F.slice(new, F.lit(1), both), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    changed = F.filter(F.transform(pairs, change), lambda x: x.isNotNull())
    return _with_rest(F.slice(changed, 1, most), F.size(changed) - most, " more changes")


def _with_rest(shown: Column, rest: Column, unit: str) -> Column:
    return F.when(rest > 0, F.concat(shown, F.array(F.concat(F.lit("... +"), rest.cast("string"), F.lit(unit))))).otherwise(shown)


def redacted(sample: Column) -> Column:
    """A sample without its values: the key stays, a count of what is left out stays, anything else goes."""
    s = F.trim(sample)
    colon, equal = F.instr(s, ":"), F.instr(s, "=")
    # the first separator of either kind ends the key: with a colon further on, nothing of the value is left standing
    first = F.when((colon > 0) & (equal > 0), F.least(colon, equal)).otherwise(F.greatest(colon, equal))
    return F.when(s.startswith("... +") & s.endswith("more"), s).when(first > 0, F.concat(F.substring(s, F.lit(1), first), F.lit("<redacted>"))).otherwise("<redacted>")


def listed(text: Column) -> Column:
    """The items of a comma-separated list, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def bare_file(name: Column) -> Column:
    """Is this a log file name without a path (or nothing)?"""
    t = F.trim(name)
    return (t == "") | ((F.length(t) <= 255) & ~t.contains("..") & t.rlike(r"^[\p{L}\p{Nd}._-]+$"))


def file_order(file: Column) -> Column:
    """A log file as something to order by: prefix and number, or the name itself where it has no number."""
    number = F.regexp_extract(file, r"^.+\.(\d+)$", 1)
    return F.struct(
        F.when(number == "", file).otherwise(F.regexp_extract(file, r"^(.+)\.\d+$", 1)).alias("prefix"),
        F.when(number == "", F.lit(-1)).otherwise(number.try_cast("decimal(20,0)")).cast("decimal(20,0)").alias("number"),
    )


def position(file: Column, pos: Column) -> Column:
    """A position in a log, to compare with others of the same log."""
    return F.struct(file_order(file).alias("file"), pos.cast("long").alias("pos"))


def collation_names(name: Column) -> Column:
    """The names a collation goes by on a server that knows it."""
    n, long = F.lower(F.trim(name)), "utf8mb4_uca1400_"
    return F.array_compact(F.array(n, F.when(n.startswith("uca1400_"), F.concat(F.lit("utf8mb4_"), n)), F.when(n.startswith(long), F.substring(n, len("utf8mb4_") + 1, 255))))


def account_class(user: Column) -> Column:
    u = F.lower(F.trim(user))
    system = u.isin("mysql.session", "mysql.sys", "mysql.infoschema", "mariadb.sys", "mysqlxsys")
    return F.when(system, "system").when(u.isin("root", "healthcheck"), "administrative").otherwise("user-managed")


def has_mode(modes: Column, mode: str) -> Column:
    """Is ``mode`` one of the comma-separated modes?"""
    return F.array_contains(F.transform(F.split(F.upper(modes), ","), lambda x: F.trim(x)), mode)


def refuses_zero_dates(modes: Column) -> Column:
    strict = has_mode(modes, "STRICT_TRANS_TABLES") | has_mode(modes, "STRICT_ALL_TABLES")
    return strict & (has_mode(modes, "NO_ZERO_DATE") | has_mode(modes, "NO_ZERO_IN_DATE"))


def zero_date(default: Column) -> Column:
    """Does a default hold a date with a zero year, month or day?"""
    v = F.trim(F.regexp_replace(default, "^[\"']+|[\"']+$", ""))
    date = F.regexp_extract(v, "^([^ T]{10})(?:[ T].*)?$", 1)
    return F.coalesce(date.rlike("^....-..-..$") & (date.startswith("0000") | (F.substring(date, 6, 2) == "00") | (F.substring(date, 9, 2) == "00")), F.lit(False))


def default_fix(schema: Column, table: Column, column: Column, kind: Column) -> Column:
    """The statement that gives a temporal column a valid default."""
    value = F.when(kind == "date", "1970-01-01").otherwise("1970-01-01 00:00:01")
    return F.concat(F.lit("ALTER TABLE "), qualified(schema, table), F.lit(" ALTER COLUMN "), quoted(column), F.lit(" SET DEFAULT '"), value, F.lit("';"))


def ddl_class(query: Column) -> Column:
    """``safe``, ``risky`` or null for what changes no schema.  Words count only between single blanks."""
    words = F.concat(F.lit(" "), F.upper(F.trim(query)), F.lit(" "))
    first = F.regexp_extract(words, r"^\s*(\S+)", 1)
    has = lambda *ws: F.greatest(*(words.contains(f" {w} ") for w in ws), F.lit(False))
    alter = F.when(has("DROP", "MODIFY", "CHANGE", "RENAME"), "risky").when(has("ADD"), "safe").otherwise("risky")
    return F.when(first.isin("DROP", "TRUNCATE", "RENAME"), "risky").when(first == "CREATE", F.when(has("OR REPLACE"), "risky").otherwise("safe")).when(first == "ALTER", alter)


def switched_on(value: Column) -> Column:
    """A server switch as a boolean; null where it is neither on nor off."""
    v = F.upper(F.trim(value.cast("string")))
    return F.when(v.isin("1", "ON", "TRUE", "YES"), True).when(v.isin("0", "OFF", "FALSE", "NO"), False)


def unsigned32(value: Column) -> Column:
    digits = F.trim(value.cast("string"))
    n = F.when(digits.rlike(r"^\d{1,18}$"), digits.cast("long"))
    return F.when(n <= 2**32 - 1, n)


def effective_zone(zone: Column, system: Column) -> Column:
    return F.when(F.upper(F.trim(zone)) == "SYSTEM", F.trim(system)).otherwise(F.trim(zone))


def lag_seconds(now: Column, then: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), now.cast("long") - then.cast("long"))


def version(raw: Column) -> Column:
    """(engine, raw_version, major, minor, patch, parsed, version) of a server's version text."""
    text = F.lower(F.trim(raw))
    part = lambda i: F.regexp_extract(raw, r"(\d+)\.(\d+)\.(\d+)", i).try_cast("int")
    parsed = raw.rlike(r"\d+\.\d+\.\d+")
    engine = F.when(text.contains("mariadb"), "mariadb").when(F.coalesce(text, F.lit("")) != "", "mysql").otherwise("unknown")
    return F.struct(engine.alias("engine"), F.trim(raw).alias("raw_version"), part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"), F.coalesce(parsed, F.lit(False)).alias("parsed"), F.when(parsed, F.concat_ws(".", part(1).cast("string"), part(2).cast("string"), part(3).cast("string"))).otherwise("").alias("version"))


def at_least(v: Column, major: int, minor: int, patch: int) -> Column:
    return F.struct(v["major"], v["minor"], v["patch"]) >= F.struct(F.lit(major), F.lit(minor), F.lit(patch))


def event_bytes(file: Column, schema: Column, table: Column, query: Column, rows: Column) -> Column:
    """What a change event takes in memory, by rule: fixed parts, text, and rows of values (as text; 8 for null)."""
    text = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    row = lambda r: F.lit(24) + F.aggregate(r, F.lit(0), lambda acc, v: acc + F.coalesce(F.octet_length(v), F.lit(8)))
    held = F.coalesce(F.aggregate(rows, F.lit(0).cast("long"), lambda acc, r: acc + row(r).cast("long")), F.lit(0).cast("long"))
    return F.lit(96).cast("long") + text(file) + text(schema) + text(table) + text(query) + held


def canonical_json(text: Column) -> Column:
    """Objects with sorted keys; text that is no JSON stays as it is."""
    return F.coalesce(F.try_parse_json(text).cast("string"), text)
