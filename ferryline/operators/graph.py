"""The foreign-key graph: edges, cycles, and the order in which tables are copied.

The graph has a node for each table, so it is small; reachability is still a frame computation (squaring: ``log2`` of the longest
path rounds), and only the order, which picks the least ready table each time, is found on the driver.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import Catalog, base_tables
from .tables import cut


def edges(catalog: Catalog, scope: DataFrame) -> DataFrame:
    """(database, table, needs): foreign keys within a database between tables in scope; references to itself are no edge."""
    tables = base_tables(catalog, scope)
    local = catalog.fk_parts.filter("ref_table is not null and (ref_database is null or ref_database = database) and table <> ref_table")
    return local.select("database", "table", F.col("ref_table").alias("needs")).distinct().join(tables, ["database", "table"], "left_semi").join(tables.withColumnRenamed("table", "needs"), ["database", "needs"], "left_semi").select("database", "table", "needs")


def reach(links: DataFrame) -> DataFrame:
    """(database, table, needs) for each path of one or more edges; paths of any length are found."""
    known, size = cut(links.distinct()), -1
    while (n := known.count()) != size:
        size = n
        on = known.select("database", F.col("table").alias("needs"), F.col("needs").alias("further"))
        known = cut(known.union(known.join(on, ["database", "needs"]).select("database", "table", F.col("further").alias("needs"))).distinct())
    return known


def cycles(links: DataFrame) -> DataFrame:
    """(database, tables): groups of two or more tables that need each other, names in order."""
    far = reach(links)
    back = far.select("database", F.col("table").alias("needs"), F.col("needs").alias("table"))
    mutual = far.join(back, ["database", "table", "needs"], "left_semi").filter("table <> needs")
    groups = mutual.groupBy("database", "table").agg(F.array_sort(F.collect_set("needs")).alias("others"))
    named = groups.select("database", F.array_sort(F.concat("others", F.array("table"))).alias("tables"))
    return named.distinct().orderBy("database", "tables")


def in_or_behind_cycles(links: DataFrame) -> DataFrame:
    """(database, table): tables no order can place - those in a cycle and all that need them."""
    far = reach(links)
    looped = far.filter("table = needs").select("database", F.col("table").alias("needs"))
    behind = far.join(looped, ["database", "needs"], "left_semi").select("database", "table")
    return behind.distinct().orderBy("database", "table")


def copy_order(tables: list[str], links: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """(order, unplaced) for one database: what a table needs comes first, the least name of those ready next; what a cycle holds
    up is appended in order of names, and told."""
    waiting = {t: {n for a, n in links if a == t and n != t and n in set(tables)} for t in tables}
    needed_by: dict[str, list[str]] = {}
    for t, needs in waiting.items():
        for n in needs:
            needed_by.setdefault(n, []).append(t)
    ready, order = [t for t, needs in waiting.items() if not needs], []
    heapq.heapify(ready)
    while ready:
        done = heapq.heappop(ready)
        order.append(done)
        for t in needed_by.get(done, ()):
            waiting[t].discard(done)
            if not waiting[t]:
                heapq.heappush(ready, t)
    unplaced = sorted(set(tables) - set(order))
    return order + unplaced, unplaced
