"""Nested outlines in JSON, and search in the results of a book's decomposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Titles of a node without one and of an outline that is made of chapters.
UNTITLED, WHOLE = "未命名", "全书大纲"
#: Levels that are walked at first; more are added while there are deeper nodes.
LEVELS = 8


def without_fence(text: Column) -> Column:
    """JSON that stands between marks of a code block."""
    return F.trim(F.regexp_replace(F.trim(text), r"^```(?:json)?|```$", ""))


def _text(node: Column, member: str, default: str) -> Column:
    return F.coalesce(F.try_variant_get(node, f"$.{member}", "string"), F.lit(default))


def _children(level: Column) -> Column:
    """The nodes one level below: (path, node) of children that are objects, each with its place among all children."""
    under = lambda n: F.coalesce(F.try_variant_get(n["node"], "$.children", "array<variant>"), F.array().cast("array<variant>"))
    placed = lambda n: F.transform(under(n), lambda c, i: F.struct(F.concat(n["path"], F.array(i)).alias("path"), c.alias("node")))
    nodes = F.flatten(F.transform(level, placed))
    return F.filter(nodes, lambda n: F.schema_of_variant(n["node"]).startswith("OBJECT"))


def _walked(rows: DataFrame, levels: int) -> DataFrame:
    """rows with the columns _0 to _levels: nodes by depth."""
    for depth in range(1, levels + 1):
        rows = rows.withColumn(f"_{depth}", _children(F.col(f"_{depth - 1}")))
    return rows


def outline_nodes(outlines: DataFrame, key: str, column: str = "json") -> DataFrame:
    """outlines(key, column) -> key, path, depth, title, summary: a row for each node of each outline.

    path has a node's places from the root down, and is empty for the root;
    depth is its length. A node without a title is UNTITLED, one without a
    summary has ''; other values are taken as text. Children that aren't
    objects are left out. A text that is null, no object, or has a root with a
    blank title gives no row. The levels are columns of one pass; how many are
    needed is asked first, so that no node is lost however deep it is."""
    parsed = outlines.select(key, F.try_parse_json(without_fence(F.col(column))).alias("root"))
    root = F.array(F.struct(F.array().cast("array<int>").alias("path"), F.col("root").alias("node")))
    fit = F.schema_of_variant("root").startswith("OBJECT") & (F.trim(_text(F.col("root"), "title", UNTITLED)) != "")
    parsed = parsed.where(F.col("root").isNotNull()).where(fit).select(key, root.alias("_0"))
    levels = LEVELS
    while _walked(parsed, levels + 1).where(F.size(f"_{levels + 1}") > 0).limit(1).count():
        levels *= 2
    rows = _walked(parsed, levels).select(key, F.explode(F.concat(*[f"_{i}" for i in range(levels + 1)])).alias("n"))
    return rows.select(key, "n.path", F.size("n.path").alias("depth"), _text(F.col("n.node"), "title", UNTITLED).alias("title"), _text(F.col("n.node"), "summary", "").alias("summary"))


def or_chapters(nodes: DataFrame, chapters: DataFrame, key: str) -> DataFrame:
    """nodes with an outline of one level, made of chapters(key, position, title, summary), for keys that have none."""
    rest = chapters.join(nodes.select(key).distinct(), key, "left_anti")
    top = rest.select(key).distinct().select(key, F.array().cast("array<int>").alias("path"), F.lit(0).alias("depth"), F.lit(WHOLE).alias("title"), F.lit("").alias("summary"))
    below = rest.select(key, F.array(F.col("position").cast("int")).alias("path"), F.lit(1).alias("depth"), "title", "summary")
    return nodes.unionByName(top).unionByName(below)


def search_results(chapters: DataFrame, wanted: Column, fields: tuple[str, ...] = ("title", "summary", "events", "characters")) -> DataFrame:
    """Chapters of which a field holds wanted, whatever the case, with the fields that do as found; a blank search finds all."""
    q = F.lower(F.trim(wanted))
    hit = lambda f: F.lower(F.coalesce(F.col(f), F.lit(""))).contains(q)
    found = F.filter(F.array(*[F.when(hit(f), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return chapters.withColumn("found", found).where(F.size("found") > 0)
