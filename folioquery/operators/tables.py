"""Table grids: cells with spans to an exactly-once slot map, neighbours, rendering, and attribute claims under header rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slots(cells: DataFrame) -> DataFrame:
    """(table_id, r, c, cell_id, origin): every slot a cell covers. cells (table_id, cell_id, r, c, row_span, col_span); where spans
    collide the slot goes to the cell whose origin comes first in reading order."""
    span = lambda start, size: F.sequence(start, start + F.greatest(F.coalesce(size, F.lit(1)), F.lit(1)) - 1)
    rows = cells.select("*", F.explode(span(F.col("r"), F.col("row_span"))).alias("y")).select("*", F.explode(span(F.col("c"), F.col("col_span"))).alias("x"))
    first = rows.groupBy("table_id", F.col("y").alias("sr"), F.col("x").alias("sc")).agg(F.min_by(F.struct("cell_id", "r", "c"), F.struct("r", "c", "cell_id")).alias("o"))
    return first.select("table_id", F.col("sr").alias("r"), F.col("sc").alias("c"), "o.cell_id", ((F.col("o.r") == F.col("sr")) & (F.col("o.c") == F.col("sc"))).alias("origin"))


def beside(grid: DataFrame, down: int, right: int, name: str) -> DataFrame:
    """(table_id, r, c, name): the cell that lies so many slots down and right of each slot."""
    other = grid.select("table_id", (F.col("r") - down).alias("r"), (F.col("c") - right).alias("c"), F.col("cell_id").alias(name))
    return grid.select("table_id", "r", "c").join(other, ["table_id", "r", "c"], "left")


def pipe_table(cells: DataFrame) -> DataFrame:
    """(table_id, text): each table as a pipe table, a row a line; cells (table_id, r, c, text)."""
    lines = cells.groupBy("table_id", "r").agg(F.array_sort(F.collect_list(F.struct("c", "text"))).alias("x")).select("table_id", "r", F.concat(F.lit("| "), F.array_join(F.transform("x", lambda s: F.coalesce(s["text"], F.lit(""))), " | "), F.lit(" |")).alias("line"))
    return lines.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda s: s["line"]), "\n").alias("text"))


def html_table(cells: DataFrame) -> DataFrame:
    """(table_id, html): each table as HTML; cells (table_id, r, c, text)."""
    safe = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    slots = cells.select("table_id", "r", "c", F.concat(F.lit("<td>"), safe, F.lit("</td>")).alias("td"))
    # The cells of a table once, ordered inside one array: one shuffle for rows and tables.
    rows = slots.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("r", "c", "td"))).alias("x"))
    opened = F.transform("x", lambda s, i: F.concat(F.when(i == 0, "<tr>").when(F.get("x", i - 1)["r"] != s["r"], "</tr><tr>").otherwise(""), s["td"]))
    return rows.select("table_id", F.concat(F.lit("<table>"), F.array_join(opened, ""), F.lit("</tr></table>")).alias("html"))


def claims(cells: DataFrame) -> DataFrame:
    """(table_id, subject, relation, value): body cells under the header row (r = 0) and beside the subject column (c = 0)."""
    head = cells.where("r = 0").select("table_id", "c", F.col("text").alias("relation"))
    subject = cells.where("c = 0").select("table_id", "r", F.col("text").alias("subject"))
    body = cells.where("r > 0 AND c > 0").select("table_id", "r", "c", F.col("text").alias("value"))
    return body.join(head, ["table_id", "c"]).join(subject, ["table_id", "r"]).select("table_id", "subject", "relation", "value")
