"""Writers: CSV with a byte order mark where readers need one, JSON lines, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_csv(df: DataFrame, path: str, columns: list[str] | None = None, mark: bool = False) -> None:
    """Header CSV. Arrays and maps are written as JSON. mark: the first column's name is led by a byte order mark."""
    df = df.select(*columns) if columns else df
    flat = df.select(*[(F.to_json(c) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`")).alias(c) for c, t in df.dtypes])
    if mark:
        flat = flat.withColumnRenamed(flat.columns[0], "﻿" + flat.columns[0])
    flat.write.mode("overwrite").csv(path, header=True, escape='"')


def json_row() -> Column:
    """A row as one JSON object, nulls kept out."""
    return F.to_json(F.struct("*"))


def to_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown_line(df: DataFrame, columns: list[str], bold: Column | None = None) -> Column:
    """A row as a line of a Markdown table. Doubles have four places, nulls are empty, pipes are escaped; cells of rows where bold holds are in bold."""
    kinds = dict(df.dtypes)

    def cell(c):
        text = F.format_string("%.4f", c) if kinds[c] in ("double", "float") else F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|"))
        text = F.coalesce(F.when(F.col(c).isNotNull(), text), F.lit(""))
        return text if bold is None else F.when(bold & (text != ""), F.concat(F.lit("**"), text, F.lit("**"))).otherwise(text)

    return F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))


def markdown_head(columns: list[str]) -> list[str]:
    return ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]


def to_markdown(df: DataFrame, path: str, order: list[str], columns: list[str] | None = None, bold: Column | None = None) -> None:
    """The whole table as text files whose names follow the order; the head is in a file of its own, which comes first."""
    columns = columns or df.columns
    df.sparkSession.createDataFrame([("\n".join(markdown_head(columns)),)], "value string").coalesce(1).write.text(f"{path}/0-head")
    df.orderBy(*order).select(markdown_line(df, columns, bold).alias("value")).write.text(f"{path}/1-rows")


def markdown(df: DataFrame, order: list[str], bold: Column | None = None, most: int = 1000) -> DataFrame:
    """markdown: the first rows of a report table as one text."""
    rows = df.orderBy(*order).limit(most).select(F.struct(*order, markdown_line(df, df.columns, bold).alias("__line")).alias("r")).agg(F.sort_array(F.collect_list("r")).alias("rows"))
    return rows.select(F.concat_ws("\n", *[F.lit(x) for x in markdown_head(df.columns)], F.array_join(F.transform("rows", lambda r: r["__line"]), "\n")).alias("markdown"))
