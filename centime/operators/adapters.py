"""From the cells of tables and workbooks to facts: roles of columns, units, perimeters, hierarchies, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from centime.functions.scalars import amount_cents, last_year, norm, year_header
from centime.operators.labels import cell_kind, header_metric, result_column
from centime.operators.lookup import forward_fill

#: Rows of a table among which its heading is looked for.
HEAD = 7


def unit_of(text: Column) -> Column:
    """Euros a unit that a heading names: 1,000,000,000, 1,000,000 or 1,000; null when it names none."""
    plain = norm(text)
    return F.when(plain.contains("milliard") | plain.contains("mdeur"), 10**9).when(plain.contains("million"), 10**6).when(plain.contains("millier"), 1000).cast("bigint")


def heading_rows(cells: DataFrame, table: list[str]) -> DataFrame:
    """(table, head_row, by): where a table's heading is: the first row that has all three metrics ('metric'), else the first with two years or more ('year')."""
    shown = cells.where(F.col("row_index") < HEAD).groupBy(*table, "row_index").agg(
        F.countDistinct(header_metric(F.col("text"))).alias("_metrics"), F.count(year_header("text")).alias("_years")
    )
    kind = F.when(F.col("_metrics") == 3, 0).when(F.col("_years") >= 2, 1)
    best = shown.where(kind.isNotNull()).groupBy(*table).agg(F.min(F.struct(kind.alias("k"), "row_index")).alias("b"))
    return best.select(*table, F.col("b.row_index").alias("head_row"), F.when(F.col("b.k") == 0, "metric").otherwise("year").alias("by"))


def table_facts(cells: DataFrame, contexts: DataFrame, entities: DataFrame, table: list[str]) -> DataFrame:
    """Facts of tables with a heading: entity, metric, year, cents, raw, unit, row_index, column_index, label, heading.

    cells: table, row_index, column_index, text. contexts: table, context (the text
    before a table; the unit comes from it and from the first rows, the year from
    it where the heading has metrics). entities: label (normalised), entity. A row
    belongs to the entity its first cell names; where the heading has years, the
    entity named last above goes on until a row without figures names another
    label, and a row states its metric in a cell of its own. Rows as wide as the
    heading only; cells that are no amount give no fact; a published 0 is one.
    """
    heads = heading_rows(cells, table)
    top = cells.where(F.col("row_index") < 4).groupBy(*table).agg(F.array_join(F.array_sort(F.collect_list(F.struct("row_index", "column_index", "text")))["text"], " ").alias("_top"))
    told = heads.join(contexts, table, "left").join(top, table, "left")
    told = told.withColumn("unit", unit_of(F.concat_ws(" ", "_top", "context"))).withColumn("year_before", last_year("context")).drop("_top", "context")
    body = cells.join(told, table).where("unit IS NOT NULL")
    heading = body.where("row_index = head_row").select(*table, "column_index", F.col("text").alias("heading"), header_metric(F.col("text")).alias("column_metric"), year_header("text").alias("column_year"))
    first = body.where("column_index = 0 AND row_index > head_row").select(*table, "row_index", F.col("text").alias("label"), norm("text").alias("_label"))
    named = first.join(entities.select(F.col("label").alias("_label"), "entity"), "_label", "left").drop("_label")
    stated = body.where("row_index > head_row").groupBy(*table, "row_index").agg(
        F.max(header_metric(F.col("text"))).alias("row_metric"), F.count(header_metric(F.col("text"))).alias("_stated"),
        F.max(F.when(F.col("column_index") > 0, amount_cents(F.col("text")))).isNotNull().alias("_figures"),
    )
    rows = named.join(stated, [*table, "row_index"]).join(heads, table)
    # a row without figures and without a known label ends what was said above
    rows = rows.withColumn("_owner", F.when(F.col("entity").isNotNull(), F.col("entity")).when(~F.col("_figures") & (F.col("_stated") == 0) & (F.col("label") != ""), F.lit("")))
    rows = forward_fill(rows, table, [F.asc("row_index")], {"_owner": "_held"})
    owner = F.when(F.col("by") == "metric", F.col("entity")).otherwise(F.nullif("_held", F.lit("")))
    rows = rows.withColumn("owner", owner).where("owner IS NOT NULL AND (by = 'metric' OR _stated = 1)").select(*table, "row_index", "owner", "label", "row_metric")
    met = body.where("row_index > head_row AND column_index > 0").join(rows, [*table, "row_index"]).join(heading, [*table, "column_index"])
    metric = F.when(F.col("by") == "metric", F.col("column_metric")).otherwise(F.col("row_metric"))
    year = F.when(F.col("by") == "metric", F.col("year_before")).otherwise(F.col("column_year"))
    facts = met.withColumn("metric", metric).withColumn("year", year).withColumn("cents", amount_cents(F.col("text"), F.col("unit")))
    return facts.where("metric IS NOT NULL AND year IS NOT NULL AND cents IS NOT NULL").select(
        *table, F.col("owner").alias("entity"), "metric", "year", "cents", F.col("text").alias("raw"), "unit", "row_index", "column_index", "label", "heading"
    )


def place_of(cell: Column) -> tuple[Column, Column]:
    """(row, column) from 0 of a cell's address such as 'AB12'."""
    letters, row = F.regexp_extract(cell, "^([A-Z]+)", 1), F.regexp_extract(cell, "([0-9]+)$", 1).cast("int") - 1
    digits = F.transform(F.split(letters, ""), lambda c: F.ascii(c) - 64)
    column = F.aggregate(F.filter(digits, lambda d: d > 0), F.lit(0), lambda s, d: s * 26 + d) - 1
    return row, column


def workbook_inventory(cells: DataFrame) -> DataFrame:
    """(path, sheet): cells, rows, columns, formulas and cells by kind, and the unit that the sheet names; files that could not be read are left out."""
    row, column = place_of(F.col("cell"))
    held = cells.where("error IS NULL AND cell IS NOT NULL").withColumn("_kind", cell_kind(F.col("raw")))
    percent = (F.col("_kind") == "percent") | ((F.col("_kind") == "number") & F.coalesce(F.col("format"), F.lit("")).contains("%"))
    return held.groupBy("path", "sheet").agg(
        F.count(F.lit(1)).alias("cells"), F.max(row + 1).alias("rows"), F.max(column + 1).alias("columns"), F.count("formula").alias("formulas"),
        F.count(F.when(F.col("_kind").isin("number", "zero"), 1)).alias("numbers"), F.count(F.when(F.col("_kind") == "zero", 1)).alias("zeros"), F.count(F.when(percent, 1)).alias("percents"),
        F.max(F.when(F.col("_kind") == "text", unit_of(F.col("raw")))).alias("unit"),
    )


def column_annex(cells: DataFrame, unit: int, label_column: int = 0) -> DataFrame:
    """Figures of sheets whose columns are years with results: path, sheet, cell, label, year, heading, cents.

    A heading is any cell above a figure, in its column, that names a year and
    results (a statement, not a forecast, a revision or a gap); the nearest counts.
    """
    row, column = place_of(F.col("cell"))
    placed = cells.where("error IS NULL AND raw IS NOT NULL").select("path", "sheet", "cell", "raw", row.alias("row"), column.alias("column"))
    year = last_year("raw")
    marked = placed.withColumn("_head", F.when(year.isNotNull() & result_column(F.col("raw")), F.struct(year.alias("year"), F.col("raw").alias("heading"))))
    above = Window.partitionBy("path", "sheet", "column").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    figures = marked.withColumn("_above", F.last("_head", ignorenulls=True).over(above)).withColumn("cents", amount_cents(F.col("raw"), unit)).where("_head IS NULL AND _above IS NOT NULL AND cents IS NOT NULL")
    names = placed.where(F.col("column") == label_column).select("path", "sheet", "row", F.col("raw").alias("label"))
    return figures.where(F.col("column") != label_column).join(names, ["path", "sheet", "row"]).select("path", "sheet", "cell", "label", "_above.year", "_above.heading", "cents")


def row_annex(cells: DataFrame, unit: int, year_column: int = 0) -> DataFrame:
    """Figures of sheets whose rows are years: path, sheet, cell, year, heading (the nearest text above in the column), cents."""
    row, column = place_of(F.col("cell"))
    placed = cells.where("error IS NULL AND raw IS NOT NULL").select("path", "sheet", "cell", "raw", row.alias("row"), column.alias("column"))
    years = placed.where(F.col("column") == year_column).select("path", "sheet", "row", year_header(F.regexp_replace("raw", r"\.0+$", "")).alias("year")).where("year IS NOT NULL")
    above = Window.partitionBy("path", "sheet", "column").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    headed = placed.withColumn("heading", F.last(F.when(cell_kind(F.col("raw")) == "text", F.col("raw")), ignorenulls=True).over(above))
    met = headed.where(F.col("column") != year_column).join(years, ["path", "sheet", "row"]).withColumn("cents", amount_cents(F.col("raw"), unit))
    return met.where("cents IS NOT NULL AND heading IS NOT NULL").select("path", "sheet", "cell", "year", "heading", "cents")


def hierarchy_rows(rows: DataFrame, section: list[str], order: list[Column], level: str, code: str, levels: int) -> DataFrame:
    """Rows of an indented list with the codes of all levels above: level_1 to level_n.

    level (1 to levels) tells what a row is. A level's code holds until a row of
    that level or of one further up; rows without a level get those that hold.
    """
    held = rows
    for i in range(1, levels + 1):
        # a row further up clears this level
        step = F.when(F.col(level) == i, F.col(code)).when(F.col(level) < i, F.lit(""))
        held = held.withColumn(f"_at_{i}", step)
    held = forward_fill(held, section, order, {f"_at_{i}": f"level_{i}" for i in range(1, levels + 1)})
    return held.select(*rows.columns, *(F.nullif(f"level_{i}", F.lit("")).alias(f"level_{i}") for i in range(1, levels + 1)))
