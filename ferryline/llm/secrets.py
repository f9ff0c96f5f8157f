"""Secret scanning with linked multipart credentials, in DataFrame functions only.

Base spans come from three patterns.  Spans are found by splitting a text at the matches: lengths of the parts between and
of the matches add up to offsets in code points, first within runs of ``RUN`` matches, then over the runs' totals, so a text with
very many matches costs little more than its length.  Offsets in bytes are summed beside them, to cut texts by.  Weak candidates (short access identifiers, long mixed tokens, endpoints
of any scheme or host:port, with or without a user part) are reported only where at most ``scope`` characters lie between
them and a complementary part: an interval join on the document and on buckets of offsets, each part standing in all buckets
from its start to its end, a candidate also in the two next to these.  A long token inside a
base span is told with that span; one of any length, after '=' or padded with '=', is a candidate.

Defined cases: a null text is the empty text; no span gives empty strings; long texts are scanned whole; repeated rows each
keep their result (rows are numbered first); an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"
WEAK_ID = "AKIA[A-Z0-9]{8,13}(?![A-Z0-9])"
WEAK_SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{24,}={0,2}(?![A-Za-z0-9+/_-])"
_HOST = r"(?:\[[0-9A-Fa-f:.]+\]|[A-Za-z0-9._-]+)(?::[0-9]+)?"
_URL = r"""(?<![A-Za-z0-9+.-])[A-Za-z0-9+.-]+://(?:[^\s/@?#"'<>]+@)?""" + _HOST + "(?:," + _HOST + r""")*+(?:[/?#][^\s"'<>]*)?"""
_PORT = r"(?<![A-Za-z0-9._:/@-])(?=[A-Za-z0-9.-]*[A-Za-z]|[0-9]+(?:\.[0-9]+){3}:)[A-Za-z0-9][A-Za-z0-9.-]*:[0-9]{2,5}(?![A-Za-z0-9])"
ENDPOINT = f"{_URL}|{_PORT}"
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")


WIDE = "array<struct<start:int,kind:int,end:int,low:int,high:int>>"
RUN = 64


def let(value, body):
    """``body`` of a variable that holds ``value``: inside a lambda an expression would be worked out anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def runs(array, n):
    """An array cut into arrays of ``n``."""
    return let(array, lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / n).cast("int")), lambda i: F.slice(a, i * n + 1, F.lit(n))))


def before(array, op):
    """For each integer of an array what ``op`` (associative, zero is neutral) makes of all integers before it, and of all, last."""
    start = F.struct(F.lit(0).alias("all"), F.array().cast("array<int>").alias("out"))
    fold = lambda a: F.aggregate(a, start, lambda acc, x: F.struct(op(acc["all"], x).alias("all"), F.concat(acc["out"], F.array(acc["all"])).alias("out")))

    def joined(pieces):
        def put(offsets):
            moved = F.zip_with(pieces, offsets["out"], lambda p, o: F.transform(p["out"], lambda y: op(o, y)))
            return F.struct(offsets["all"].alias("all"), F.flatten(moved).alias("out"))

        return let(fold(F.transform(pieces, lambda p: p["all"])), put)

    inner = F.transform(runs(array, RUN), fold)
    whole = let(F.transform(runs(inner, RUN), joined), joined)
    return let(whole, lambda w: F.concat(w["out"], F.array(w["all"])))


def spans(text, pattern: str, kind: int, keep=None):
    """Array of the non-overlapping matches of ``pattern``, leftmost first: (start, kind, end) in code points, (low, high) in bytes."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def located(parts):
        add = lambda a, b: a + b
        at = before(F.transform(parts, lambda p: F.length(p["b"]) + F.length(p["m"])), add)
        byte = before(F.transform(parts, lambda p: F.octet_length(p["b"]) + F.octet_length(p["m"])), add)
        placed = F.zip_with(F.zip_with(parts, F.slice(at, 2, F.size(parts)), lambda p, e: F.struct(p["m"].alias("m"), e.alias("end"))), F.slice(byte, 2, F.size(parts)), lambda p, h: F.struct((p["end"] - F.length(p["m"])).alias("start"), F.lit(kind).alias("kind"), p["end"].alias("end"), (h - F.octet_length(p["m"])).alias("low"), h.alias("high"), (keep(p["m"]) if keep else F.lit(True)).alias("ok")))
        return F.transform(F.filter(placed, lambda x: x["ok"]), lambda x: F.struct(*(x[c].alias(c) for c in ("start", "kind", "end", "low", "high"))))

    parts = let(found, lambda f: F.zip_with(F.slice(between, F.lit(1), F.size(f)), f, lambda b, m: F.struct(b.alias("b"), m.alias("m"))))
    return F.when(text.rlike(pattern), let(parts, located)).otherwise(F.array().cast(WIDE))


def blanked(text, spans, mark: str):
    """``text`` with each run of touching or overlapping ``spans`` (wide, in order) overwritten by ``mark``."""
    raw = F.encode(text, "UTF-8")

    def written(ends):
        parts = F.zip_with(spans, F.slice(ends, 1, F.size(spans)), lambda s, e: F.struct(e.alias("from"), s["low"].alias("to")))
        opens = F.filter(parts, lambda p: (p["to"] > p["from"]) | (p["to"] == 0))
        pieces = F.transform(opens, lambda p: F.decode(F.substring(raw, p["from"] + 1, p["to"] - p["from"]), "UTF-8"))
        return F.concat(F.array_join(pieces, mark), F.lit(mark), F.decode(F.substring(raw, F.element_at(ends, -1) + 1, F.octet_length(text)), "UTF-8"))

    return F.when(F.size(spans) == 0, text).otherwise(let(before(F.transform(spans, lambda s: s["high"]), lambda a, b: F.greatest(a, b)), written))


def rendered(array):
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(array), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))))


@common.owned
def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = 200, carry: tuple[str, ...] = (), wide: bool = False) -> DataFrame:
    """(doc_id, base array<span>, extra array<span>[, carried columns of ``docs``]); ``wide`` spans also tell bytes.

    Extra spans are weak parts with a complementary part in scope.  Only texts that hold weak parts are shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct(F.lit(0).alias("none"), *(F.col(c).alias(c) for c in carry)).alias("carried"))
    base = F.concat(
        spans(text, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 12),
        spans(text, ACCESS, 1, lambda m: F.length(m) >= 18),
        spans(text, HEX, 2),
    )
    weak = F.concat(spans(text, WEAK_ID, 3), spans(text, WEAK_SECRET, 4), spans(text, ENDPOINT, 5))
    found = common.cut(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", base.alias("base"), weak.alias("weak"), "carried"))
    parts = found.filter("size(weak) > 0").select("row", F.explode(F.concat("base", "weak")).alias("s")).select("row", "s.*")
    bucket = lambda c: F.floor(F.col(c) / scope).cast("long")
    # a long token inside a base span is told with that span: an interval join on the buckets of both
    told = parts.filter("kind = 4").withColumn("bucket", bucket("start")).alias("w").join(
        parts.filter("kind < 3").select("row", F.col("start").alias("s2"), F.col("end").alias("e2"), F.explode(F.sequence(bucket("start"), bucket("end"))).alias("bucket")).alias("b"),
        F.expr("w.row = b.row and w.bucket = b.bucket and b.s2 <= w.start and w.end <= b.e2"), "left_semi").select("row", "start", "kind")
    # an identifier needs a secret or an endpoint, a secret needs an identifier or an endpoint, an endpoint either
    role = F.when(F.col("kind").isin(1, 3), 0).when(F.col("kind").isin(0, 2, 4), 1).otherwise(2)
    parts = parts.join(told, ["row", "start", "kind"], "left_anti").withColumn("role", role)
    left = parts.filter("kind >= 3").withColumn("bucket", F.explode(F.sequence(bucket("start") - 1, bucket("end") + 1)))
    right = parts.select("row", F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("role").alias("r2"), F.explode(F.sequence(bucket("start"), bucket("end"))).alias("bucket")).distinct()
    near = (F.col("l.start") - F.col("r.e2") <= scope) & (F.col("r.s2") - F.col("l.end") <= scope)
    linked = left.alias("l").join(right.alias("r"), (F.col("l.row") == F.col("r.row")) & (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.role") != F.col("r.r2")) & near, "left_semi")
    extra = linked.groupBy("row").agg(F.collect_set(F.struct("start", "kind", "end", "low", "high")).alias("extra"))
    shown = lambda c: c if wide else F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    columns = ["doc_id", shown(F.col("base")).alias("base"), shown(F.coalesce("extra", F.array().cast(WIDE))).alias("extra"), *(F.col("carried").getField(c).alias(c) for c in carry)]
    plain = found.filter("size(weak) = 0").withColumn("extra", F.lit(None).cast(WIDE)).select(*columns)
    return plain.unionByName(found.filter("size(weak) > 0").join(extra, "row", "left").select(*columns))


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(rendered(F.col("base")), 256).alias("base_sha256"), rendered(F.concat("base", "extra")).alias("spans"))
