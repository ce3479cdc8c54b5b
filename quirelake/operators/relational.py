"""Row operators: lookups, predicates, orders, and writes as whole-table algebra.

Writes return the table's next state, so that they can be planned together and
stored by one overwrite; keys decide what is replaced. All are joins or
windows by key, never driver loops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paged(df: DataFrame, order: Sequence[str], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def nocase(column: str) -> Column:
    """A sort key that folds ASCII letters only."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.col(column), upper, lower)


def contains_nocase(column: str, part: str) -> Column:
    return F.lower(F.col(column)).contains(part.lower())


def like_any(pattern: str, *columns: str) -> Column:
    """SQL LIKE over several columns; % and _ in the pattern are wildcards."""
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).ilike(f"%{pattern}%")
    return out


def all_terms(text: str, *columns: str) -> Column:
    """Every white-space separated term occurs in one of the columns, whatever its case."""
    out = F.lit(True)
    for term in text.split():
        hit = F.lit(False)
        for c in columns:
            hit = hit | contains_nocase(c, term)
        out = out & hit
    return out


def same_pair(a: str, b: str, x, y) -> Column:
    """The unordered pair of columns (a, b) is {x, y}."""
    return (F.least(a, b) == F.least(F.lit(x), F.lit(y))) & (F.greatest(a, b) == F.greatest(F.lit(x), F.lit(y)))


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Insert or replace: rows win over the table by key; of rows with one key the last in order wins."""
    if order:
        w = Window.partitionBy(*keys).orderBy(*order)
        rows = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return table.join(rows.select(*keys), list(keys), "left_anti").select(table.columns).unionByName(rows.select(table.columns))


def insert_ignore(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    new = rows.dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti")
    return table.unionByName(new.select(table.columns))


def update(table: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns of changes replace the table's where the key matches; null leaves a value as it is."""
    new = [c for c in changes.columns if c not in keys]
    marked = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in new])
    return table.join(marked, list(keys), "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in new else F.col(c) for c in table.columns])


def accumulate(table: DataFrame, deltas: DataFrame, key: str, column: str) -> DataFrame:
    """column += the sum of deltas by key."""
    total = deltas.groupBy(key).agg(F.sum(column).alias("_delta"))
    return table.join(total, key, "left").withColumn(column, F.col(column) + F.coalesce("_delta", F.lit(0))).select(table.columns)


def delete(table: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.join(gone.select(*keys), list(keys), "left_anti").select(table.columns)


def cascade_delete(tables: dict[str, DataFrame], parents: dict[str, tuple[str, str, str]], root: str, gone: DataFrame) -> dict[str, DataFrame]:
    """Delete the keys gone(root's key) and all rows that hang on them.

    parents: child -> (parent, parent's key, child's column); children are
    given after their parents. A child's deleted rows are those whose parent
    is deleted, found by one semi-join for each edge."""
    dead = {root: gone}
    out = dict(tables)
    key = gone.columns[0]
    out[root] = delete(tables[root], gone, [key])
    for child, (parent, parent_key, column) in parents.items():
        if parent not in dead:
            continue
        lost = dead[parent].select(F.col(parent_key).alias(column))
        dead[child] = tables[child].join(lost, column, "left_semi")
        out[child] = tables[child].join(lost, column, "left_anti").select(tables[child].columns)
    return out


def replace_group(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Delete then insert: all rows of the groups that rows holds are replaced."""
    return delete(table, rows.select(key).distinct(), [key]).unionByName(rows.select(table.columns))


def daily_rollup(table: DataFrame, events: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Read-modify-write of totals by key: one aggregation over both."""
    both = table.select(*keys, value).unionByName(events.select(*keys, value))
    return both.groupBy(*keys).agg(F.sum(value).alias(value))


def batch_import(table: DataFrame, files: DataFrame, base: str, order: str) -> DataFrame:
    """files with status: success, duplicate (name is stored, or came before in this batch) or failure (error is not null)."""
    first = F.row_number().over(Window.partitionBy(base, F.col("error").isNull()).orderBy(order))
    stored = table.select(base).distinct().withColumn("_stored", F.lit(True))
    out = files.withColumn("_n", first).join(stored, base, "left")
    seen = F.coalesce("_stored", F.lit(False)) | (F.col("error").isNull() & (F.col("_n") > 1))
    return out.select(*files.columns, F.when(seen, "duplicate").when(F.col("error").isNotNull(), "failure").otherwise("success").alias("status"))


def import_report(statuses: DataFrame, order: str) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    return statuses.agg(count("success").alias("success"), count("duplicate").alias("duplicate"), count("failure").alias("failure"), F.min_by("error", F.when(F.col("status") == "failure", F.col(order))).alias("first_error"))


def tag_books(bridge: DataFrame, books: DataFrame, tag_id: int) -> DataFrame:
    new = books.select(F.col("book_id"), F.lit(tag_id).cast("long").alias("tag_id"))
    return insert_ignore(bridge, new, ["book_id", "tag_id"])


def untag_books(bridge: DataFrame, books: DataFrame, tag_id: int) -> DataFrame:
    return delete(bridge, books.select("book_id", F.lit(tag_id).cast("long").alias("tag_id")), ["book_id", "tag_id"])


def export_conversation(messages: DataFrame) -> DataFrame:
    """One text per conversation: its messages in order, "role: content" a line."""
    line = F.concat_ws(": ", "role", "content")
    lines = F.sort_array(F.collect_list(F.struct("turn", line.alias("line"))))
    return messages.groupBy("conversation_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"), F.count("*").alias("n_messages"))
