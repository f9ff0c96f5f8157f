"""May data move from one server version to another?  Pairs of versions against four profiles, as a report with findings.

Rules are rows of one table, evaluated for every pair at once: a rule has a code, a severity, a condition and whether it blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# The version lines that each profile knows, and the pairs of lines that may be crossed.
LTS_LINES = (("mysql", 8, 4, "MySQL 8.4.x"), ("mariadb", 10, 11, "MariaDB 10.11.x"), ("mariadb", 11, 4, "MariaDB 11.4.x"), ("mariadb", 11, 8, "MariaDB 11.8.x"))
CROSS_LINES = (("MySQL 8.4.x", "MariaDB 11.4.x"), ("MariaDB 11.4.x", "MySQL 8.4.x"))
CANDIDATES = (("MySQL 8.4.x", "MariaDB 11.8.x"), ("MariaDB 11.8.x", "MySQL 8.4.x"))
RANGES = (("mysql", 8, 4, 4, "MySQL 8.4-8.4"), ("mariadb", 10, 11, 11, "MariaDB 10.11-10.11"), ("mariadb", 11, 4, 8, "MariaDB 11.4-11.8"))
LEGACY = (("mysql", 8, 0, "MySQL 8.0.x"), ("mariadb", 10, 6, "MariaDB 10.6.x"))
PROFILES = ("strict-lts", "same-major", "adjacent-minor", "max-compat")


def profile_name(profile: Column) -> Column:
    """A known profile, else the strictest."""
    p = F.lower(F.trim(profile))
    return F.when(p.isin(*PROFILES), p).otherwise("strict-lts")


def line_of(v: Column, lines=LTS_LINES) -> Column:
    """The label of the version line that ``v`` is on, or null."""
    return F.coalesce(*(F.when((v["engine"] == e) & (v["major"] == major) & (v["minor"] == minor), F.lit(label)) for e, major, minor, label in lines))


def range_of(v: Column) -> Column:
    return F.coalesce(*(F.when((v["engine"] == e) & (v["major"] == major) & v["minor"].between(low, high), F.lit(label)) for e, major, low, high, label in RANGES))


def one_of(a: Column, b: Column, pairs) -> Column:
    return F.coalesce(F.greatest(*((a == x) & (b == y) for x, y in pairs)), F.lit(False))


def order_of(a: Column, b: Column) -> Column:
    """Above, equal to or below zero as version ``a`` is above, equal to or below ``b``."""
    return F.coalesce(*(F.nullif(a[p] - b[p], F.lit(0)) for p in ("major", "minor", "patch")), F.lit(0))


def summary_of(lines) -> str:
    return ", ".join(f"{x[-1]}->{x[-1]}" for x in lines)


def rules() -> list[tuple[str, str, Column, bool, Column, str]]:
    """(code, severity, condition, blocks, message, proposal) in the order they are reported; conditions are never null."""
    s, d, p, scoped = F.col("source"), F.col("dest"), F.col("profile"), F.col("selected_databases") > 0
    known = s["parsed"] & d["parsed"] & (s["engine"] != "unknown") & (d["engine"] != "unknown")
    cross = known & (s["engine"] != d["engine"])
    down = known & (s["engine"] == d["engine"]) & (order_of(s, d) > 0)
    a, b, ra, rb = line_of(s), line_of(d), range_of(s), range_of(d)
    lines, ranges = a.isNotNull() & b.isNotNull(), ra.isNotNull() & rb.isNotNull()
    is_ = lambda *names: p.isin(*names)
    same = lambda x, y: F.coalesce(x == y, F.lit(False))
    crossed, candidate = one_of(a, b, CROSS_LINES), one_of(a, b, CANDIDATES)
    path = F.concat(s["engine"], F.lit(" "), s["version"], F.lit(" -> "), d["engine"], F.lit(" "), d["version"])
    major, minor = s["major"] == d["major"], s["minor"] - d["minor"]
    out: list = []
    add = lambda *rule: out.append(rule)
    add("downgrade_profile_selected", "info", F.lit(True), False, F.concat(F.lit("Profile in force: "), p), "Choose another profile to tune how strict the check is.")
    add("partial_database_scope", "info", scoped, False, F.concat(F.lit("Only some databases are in scope: "), F.col("selected_databases").cast("string")), "Keep the scope narrow for phased moves.")
    add("version_or_engine_unparseable", "error", ~known, True, F.lit("Source or destination does not tell a version that can be read."), "Check access to both servers and plan again.")
    add("cross_engine_path", "warn", cross, False, F.concat(F.lit("The engines differ: "), path), "Plan and verify a part first, and read the report of incompatible objects.")
    strict = cross & is_("strict-lts")
    add("strict_lts_cross_engine_out_of_range", "error", strict & ~lines, True, F.concat(F.lit("A version is on no known line: "), path), f"Lines that may be crossed: {', '.join('->'.join(x) for x in CROSS_LINES)}.")
    add("strict_lts_cross_engine_matrix_mismatch", "error", strict & lines & ~crossed, True, F.concat(F.lit("These lines may not be crossed: "), path), "Go in stages, or relax the profile after a review.")
    add("strict_lts_cross_engine_matrix_match", "info", strict & lines & crossed, False, F.concat(F.lit("Lines matched: "), a, F.lit(" -> "), b), "Go on with phased moves and full verification.")
    add("profile_same_engine_only", "error", cross & is_("same-major", "adjacent-minor"), True, F.concat(F.lit("The profile stays on one engine: "), path), "Use strict-lts for the matrix, or max-compat after a review.")
    relaxed = cross & is_("max-compat")
    add("cross_engine_matrix_candidate_unconfirmed", "warn", relaxed & candidate, False, F.concat(F.lit("Both lines are active, the pair is not validated: "), path), "Run every verification mode and keep the evidence.")
    add("cross_engine_matrix_candidate_validation_required", "warn", relaxed & candidate, False, F.lit("The pair must be validated before the strict profile takes it up."), "Collect clean staged runs in both directions.")
    add("cross_engine_matrix_candidate_partial_scope_recommended", "info", relaxed & candidate & ~scoped, False, F.lit("The full scope is selected for a pair that is not validated."), "Start with a part of the databases.")
    add("cross_engine_matrix_candidate_partial_scope_active", "info", relaxed & candidate & scoped, False, F.lit("A part of the databases is moved over a pair that is not validated."), "Repeat until verification is clean, then widen the scope.")
    add("cross_engine_matrix_unmapped", "warn", relaxed & ~candidate & ~crossed, False, F.concat(F.lit("Outside the matrix: "), path), "Run every verification mode and move in stages.")
    add("cross_engine_matrix_mapped", "info", relaxed & ~candidate & crossed, False, F.concat(F.lit("In the matrix: "), path), "The profile stays permissive: verify and report all the same.")
    add("downgrade_detected", "warn", down, False, F.concat(F.lit("The destination is older: "), path), "The profile decides which steps down are allowed.")
    lts = down & is_("strict-lts")
    add("strict_lts_matrix_out_of_range", "error", lts & ~lines, True, F.concat(F.lit("A version is outside the lines: "), path), f"Lines: {summary_of(LTS_LINES)}.")
    add("strict_lts_matrix_mismatch", "error", lts & lines & ~same(a, b), True, F.concat(F.lit("The step leaves its line: "), path), "Stay on one line, or relax the profile after a review.")
    add("strict_lts_matrix_match", "info", lts & lines & same(a, b), False, F.concat(F.lit("Line matched: "), a), "Go on under the strict profile.")
    for name, code in (("same-major", "same_major"), ("adjacent-minor", "adjacent_minor")):
        here = down & is_(name)
        add(f"{code}_matrix_out_of_range", "error", here & ~ranges, True, F.concat(F.lit("A version is outside the ranges: "), path), f"Ranges: {summary_of(RANGES)}.")
        add("downgrade_major_mismatch", "error", here & ranges & ~major, True, F.concat(F.lit("The step changes the major version: "), path), "Go through a version of the same major, or relax the profile.")
        add(f"{code}_matrix_mismatch", "error", here & ranges & major & ~same(ra, rb), True, F.concat(F.lit("The step leaves its range: "), path), "Stay in one range, or relax the profile.")
        fits = here & ranges & major & same(ra, rb)
        if code == "adjacent_minor":
            add("downgrade_minor_gap", "error", fits & (minor > 1), True, F.concat(F.lit("More than one minor version down: "), path), "Go down one minor version at a time.")
            fits = fits & (minor <= 1)
        add(f"{code}_matrix_match", "info", fits, False, F.concat(F.lit("Range matched: "), ra), "Go on with full verification.")
    loose = down & is_("max-compat")
    add("max_compat_profile", "warn", loose, False, F.lit("Checks on steps down are relaxed."), "Verify in full and read the reports before the move.")
    for v, side in ((s, "source"), (d, "destination")):
        add("max_compat_legacy_line", "warn", loose & line_of(v, LEGACY).isNotNull(), False, F.concat(F.lit(f"The {side} is on a legacy line: "), line_of(v, LEGACY)), "Prefer an active line.")
    return out, known, cross, down


def evaluate(pairs: DataFrame) -> DataFrame:
    """(.., compatible, downgrade, requires_evidence, downgrade_profile, findings) for rows (source, dest: versions as texts,
    profile, selected_databases int)."""
    read = pairs.withColumns({"source": text.version(F.col("source")), "dest": text.version(F.col("dest")), "profile": profile_name(F.coalesce("profile", F.lit("")))})
    table, known, cross, down = rules()
    finding = lambda code, severity, message, proposal: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"), F.lit(proposal).alias("proposal"))
    listed = [F.when(condition, finding(code, severity, message, proposal)) for code, severity, condition, _, message, proposal in table]
    blocked = F.lit(False)
    for _, _, condition, blocks, _, _ in table:
        if blocks:
            blocked = blocked | condition
    compatible = ~F.coalesce(blocked, F.lit(False))
    ends = [
        F.when(known & ~down & (~cross | compatible), finding("no_downgrade_detected", "info", F.lit("The destination is not older on the same engine."), "Go on with plan, move, verify and report.")),
        F.when(down & compatible, finding("downgrade_allowed_by_profile", "info", F.lit("The profile allows this step down."), "Keep the reports for a decision to go back.")),
    ]
    evidence = F.coalesce(cross & (F.col("profile") == "max-compat") & one_of(line_of(F.col("source")), line_of(F.col("dest")), CANDIDATES), F.lit(False))
    return read.withColumns({"compatible": compatible, "downgrade": F.coalesce(down, F.lit(False)), "requires_evidence": evidence, "downgrade_profile": F.col("profile"), "findings": F.array_compact(F.array(*listed, *ends))})
