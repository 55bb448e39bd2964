"""Tables in extracted text: detection, parsing, Markdown rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions import rules
from inkmill.functions import text as tx


def column_classes(x, ignore_case: bool = True) -> dict[str, Column]:
    """Column class -> whether the stripped line is of it."""
    y = tx.ustrip(x)
    return {name: tx.has(y, p, ignore_case) for name, p in rules.COLUMN_CLASSES.items()}


def detect(rows: DataFrame, *keys: str, min_rows: int = 5) -> DataFrame:
    """keys, n_lines, a count per column class, is_table and table_type of groups of lines
    (keys, text). A group of min_rows lines is a table if every class of a known type occurs
    at least min_rows / 4 times; its type is the first whose classes occur three times."""
    kinds = column_classes("text")
    out = rows.groupBy(*keys).agg(F.count("*").alias("n_lines"), *[F.sum(c.cast("int")).alias(f"n_{k}") for k, c in kinds.items()])
    every = lambda names, n: F.array_min(F.array(*[F.col(f"n_{k}") for k in names])) >= n
    is_table, kind = F.lit(False), F.lit(None).cast("string")
    for name, names in reversed(rules.TABLE_TYPES.items()):
        is_table = is_table | every(names, min_rows / 4)
        kind = F.when(every(names, 3), F.lit(name)).otherwise(kind)
    return out.withColumn("is_table", (F.col("n_lines") >= min_rows) & is_table).withColumn("table_type", kind)


_ROWS = "array<array<string>>"


def _rows(lines, starts, place) -> Column:
    """A fold over stripped, non-empty lines: starts(line) opens a row; place(row, line) gives
    the row with the line put in; lines before the first row are dropped."""
    clean = F.filter(F.transform(tx._c(lines), tx.ustrip), lambda x: x != "")
    zero = F.struct(F.array().cast(_ROWS).alias("done"), F.array().cast("array<string>").alias("row"), F.lit(0).alias("at"))
    flush = lambda s: F.when(F.size(s["row"]) > 0, F.array_append(s["done"], s["row"])).otherwise(s["done"])

    def step(s: Column, x: Column) -> Column:
        row, at = place(s, x)
        return (
            F.when(starts(x), F.struct(flush(s).alias("done"), F.array(x).alias("row"), F.lit(1).alias("at")))
            .when(F.size(s["row"]) > 0, F.struct(s["done"].alias("done"), row.alias("row"), at.alias("at")))
            .otherwise(s)
        )

    return F.aggregate(clean, zero, step, flush)


def _extended(row: Column, x: Column) -> Column:
    """The last cell with x after it."""
    return F.array_append(F.slice(row, 1, F.size(row) - 1), F.concat_ws(" ", F.element_at(row, -1), x))


def parse_class_table(lines) -> Column:
    """Rows of a class table: a class name opens a row, the first other line is its
    description and further ones go on from it, hit dice and abilities are cells."""
    p = rules.COLUMN_CLASSES

    def place(s: Column, x: Column) -> tuple[Column, Column]:
        cell = tx.has(x, p["hit_die"]) | tx.has(x, p["ability"]) | (F.size(s["row"]) == 1)
        return F.when(cell, F.array_append(s["row"], x)).otherwise(_extended(s["row"], x)), s["at"]

    # An ability is a capitalised word too: as in the lines' order, the class name wins.
    return _rows(lines, lambda x: tx.has(x, p["class_name"]), place)


def parse_level_table(lines) -> Column:
    """Rows of a level table: a level opens a row; a line is the next cell if it is of the
    next column's class, else it goes on from the last cell."""
    p = rules.COLUMN_CLASSES
    kinds = {"Proficiency Bonus": "modifier", "Rage Damage": "modifier", "Features": "feature", "Rages": "number", "Level": "level"}
    names = rules.TABLE_COLUMNS["level_progression"]

    def place(s: Column, x: Column) -> tuple[Column, Column]:
        fits = F.lit(False)
        for i, name in enumerate(names):
            ok = tx.has(x, p[kinds[name]])
            ok = ok | (F.lower(x) == "unlimited") if name == "Rages" else ok
            fits = F.when(s["at"] == i, ok).otherwise(fits)
        return F.when(fits, F.array_append(s["row"], x)).otherwise(_extended(s["row"], x)), s["at"] + fits.cast("int")

    return _rows(lines, lambda x: tx.has(x, p["level"]), place)


def parse(lines, table_type: Column) -> Column:
    """struct(table_type, columns, rows); null for lines that are of no known type."""
    made = lambda name, rows: F.struct(F.lit(name).alias("table_type"), F.array(*[F.lit(c) for c in rules.TABLE_COLUMNS[name]]).alias("columns"), rows.alias("rows"))
    return F.when(table_type == "class_table", made("class_table", parse_class_table(lines))).when(table_type == "level_progression", made("level_progression", parse_level_table(lines)))


def markdown_table(columns: Column, rows: Column, caption: Column | None = None) -> Column:
    """The table in Markdown: rows padded and cut to the columns. Without columns or rows a
    note says so. A caption stands above in bold."""
    n = F.size(columns)
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))
    fit = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(n - F.size(r), F.lit(0)))), 1, n)
    body = F.array_join(F.concat(F.array(line(columns), line(F.array_repeat(F.lit("---"), n))), F.transform(rows, lambda r: line(fit(r)))), "\n")
    out = F.when(columns.isNull() | rows.isNull(), F.lit("Table data unavailable")).when((n == 0) | (F.size(rows) == 0), F.lit("Empty table")).otherwise(body)
    return out if caption is None else F.concat(F.lit("**"), caption, F.lit("**\n\n"), out)


def table_of_rows(df: DataFrame, columns: list[str], *keys: str, order: list[str]) -> DataFrame:
    """keys, markdown: the rows of each group as one Markdown table, in the given order."""
    cells = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], cells.alias("cells"))))
    out = df.groupBy(*keys).agg(rows.alias("r"))
    return out.select(*keys, markdown_table(F.array(*[F.lit(c) for c in columns]), F.transform("r", lambda x: x["cells"])).alias("markdown"))
