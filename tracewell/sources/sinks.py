"""Sinks (S10, S11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that an archive leaves out: what people typed, and messages (fixed values).
NOT_ARCHIVED = {"calls": ("input", "error"), "faults": ("error",), "events": ("detail",)}


def report_json(rows: DataFrame, notes: DataFrame, topic: str, store: str, title: str) -> DataFrame:
    """A report as one JSON object (topic, store, title, columns, rows, notes). An empty window has no rows, not null."""
    cells = F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in rows.columns))
    body = rows.select(F.struct(F.monotonically_increasing_id().alias("at"), cells.alias("cells")).alias("r")).agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["cells"]).alias("rows"))
    said = notes.agg(F.array_sort(F.collect_list(F.concat_ws(" ", *(F.col(c).cast("string") for c in notes.columns)))).alias("notes"))
    whole = F.struct(F.lit(topic).alias("topic"), F.lit(store).alias("store"), F.lit(title).alias("title"), F.array(*map(F.lit, rows.columns)).alias("columns"), F.col("rows"), F.col("notes"))
    return body.crossJoin(F.broadcast(said)).select(F.to_json(whole).alias("value"))  # one row and one row


def write_report(rows: DataFrame, notes: DataFrame, path: str, topic: str, store: str = "", title: str = "") -> None:
    report_json(rows, notes, topic, store, title).write.mode("overwrite").text(path)


def archived(table: DataFrame, name: str) -> DataFrame:
    return table.drop(*NOT_ARCHIVED.get(name, ()))


def write_archive(table: DataFrame, name: str, path: str) -> None:
    """A table without the columns that an archive leaves out, added to what is there."""
    archived(table, name).write.mode("append").parquet(path)
