"""Loosely laid out sheets: find the header, name and type the columns."""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCAN_ROWS, MIN_TEXT, MIN_NUMBERS = 30, 3, 2

# Spellings of known headers, after cleaning, and their names.
CANONICAL = {
    "product id": "product_id",
    "product name": "product_name",
    "opening stock": "opening_stock",
    "purchase/stock in": "stock_in",
    "number of units sold": "units_sold",
    "hand-in-stock": "hand_in_stock",
    "hand in stock": "hand_in_stock",
    "cost price per unit (usd)": "cost_price_per_unit_usd",
    "cost price total (usd)": "cost_price_total_usd",
}


def is_number(cell: Column, kind: Column) -> Column:
    """A number, or text that reads as one once commas are gone; booleans are none."""
    bare = F.regexp_replace(F.trim(cell), ",", "")
    reads = bare.rlike(r"^[+-]?(?:(?:[0-9]+(?:_[0-9]+)*)?\.?[0-9]+(?:_[0-9]+)*\.?(?:[eE][+-]?[0-9]+)?|(?i:nan|inf|infinity))$")
    return F.coalesce((kind == "number") | ((kind == "text") & reads), F.lit(False))


def header_row(grid: DataFrame) -> int | None:
    """Row number of the header: among the first ``SCAN_ROWS`` the first with three texts that aren't numbers whose next row has two numbers.

    ``grid``: row_idx, cells, cell_kind.  Only the head of the sheet is looked at.
    """
    cell = F.arrays_zip(F.col("cells").alias("c"), F.col("cell_kind").alias("k"))
    count = lambda test: F.size(F.filter(cell, test))
    rows = grid.where(F.col("row_idx") <= SCAN_ROWS).select("row_idx", count(lambda x: F.coalesce((x["k"] == "text") & (F.trim(x["c"]) != "") & ~is_number(x["c"], x["k"]), F.lit(False))).alias("texts"), count(lambda x: is_number(x["c"], x["k"])).alias("numbers"))
    following = F.lead("numbers").over(Window.orderBy("row_idx"))
    found = rows.withColumn("below", following).where((F.col("row_idx") < SCAN_ROWS) & (F.col("texts") >= MIN_TEXT) & (F.col("below") >= MIN_NUMBERS))
    return found.agg(F.min("row_idx")).first()[0]


def clean_label(raw: Column) -> Column:
    """One line, single spaces, and none behind a hyphen or a slash."""
    return F.trim(F.regexp_replace(F.regexp_replace(raw, r"([-/])\s+", "$1"), r"\s+", " "))


def column_name(label: Column) -> Column:
    """The known name of a clean label, else its letters and digits with underscores between; ``column`` if it has none."""
    low = F.lower(label)
    known = F.create_map(*[F.lit(x) for pair in CANONICAL.items() for x in pair])
    # what stands in brackets is a word behind a space
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"\(([^)]*)\)", " $1"), "[^a-z0-9]+", "_"), "^_|_$", "")
    return F.coalesce(F.try_element_at(known, low), F.when(plain != "", plain), F.lit("column"))


def column_names(spark: SparkSession, headers: list[str | None]) -> list[tuple[str, str]]:
    """(name, original) of each header; a blank one is ``unnamed``, the second of a name ends in _2, and so on."""
    rows = spark.createDataFrame(list(enumerate(headers)), "pos int, raw string").withColumn("label", F.coalesce(clean_label(F.col("raw")), F.lit("")))
    named = rows.withColumn("name", F.when(F.col("label") == "", "unnamed").otherwise(column_name(F.col("label"))))
    again = F.row_number().over(Window.partitionBy("name").orderBy("pos"))
    shown = named.withColumn("n", again).withColumn("name", F.when(F.col("n") > 1, F.concat_ws("_", "name", "n")).otherwise(F.col("name")))
    return [(r["name"], r["label"]) for r in shown.orderBy("pos").collect()]  # as many rows as the sheet has columns


def infer_types(rows: DataFrame) -> dict[str, str]:
    """Of string columns: bigint if all values are whole numbers, double if all are numbers, else string; one pass over the table."""
    number = lambda c: F.when(F.trim(c).rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), F.trim(c).try_cast("double"))
    tests = [F.struct(F.count(c).alias("n"), F.count(number(F.col(c))).alias("k"), F.bool_and(number(F.col(c)) % 1 == 0).alias("whole")).alias(c) for c in rows.columns]
    if not tests:
        return {}
    found = rows.agg(*tests).first()
    return {c: "string" if found[c]["k"] < found[c]["n"] or not found[c]["n"] else "bigint" if found[c]["whole"] else "double" for c in rows.columns}


def load_grid(grid: DataFrame) -> DataFrame:
    """The sheet as a table: columns that are empty throughout and rows that are empty go, names and types are found, originals are kept as metadata.

    A blank cell is null whatever its column's type.  Raises ValueError where no header is found.
    """
    head = header_row(grid)
    if head is None:
        raise ValueError("no header row found")
    width = grid.agg(F.max(F.size("cells"))).first()[0]
    blank = lambda i: F.nullif(F.trim(F.get("cells", F.lit(i))), F.lit(""))
    full = grid.agg(*[F.count(blank(i)).alias(str(i)) for i in range(width)]).first()
    kept = [i for i in range(width) if full[str(i)]]
    titles = grid.where(F.col("row_idx") == head).select(*[F.get("cells", F.lit(i)).alias(str(i)) for i in kept]).first()
    names = column_names(grid.sparkSession, list(titles))
    value = lambda i: F.when(F.get("cell_kind", F.lit(i)) == "bool", F.when(F.lower(blank(i)) == "true", "1").otherwise("0")).otherwise(blank(i))
    body = grid.where(F.col("row_idx") > head).select("row_idx", *[value(i).alias(n) for i, (n, _) in zip(kept, names, strict=True)])
    columns = [n for n, _ in names]
    body = body.where(F.coalesce(*[F.col(f"`{c}`") for c in columns]).isNotNull())
    kinds = infer_types(body.select(*[F.col(f"`{c}`") for c in columns]))
    # a whole number is read as such; only one written with a point or an exponent goes through a double
    whole = lambda c: F.coalesce(F.trim(c).try_cast("decimal(38,0)").try_cast("bigint"), c.try_cast("double").try_cast("bigint"))
    cast = lambda c: F.when(F.trim(F.col(f"`{c}`")).rlike("^[+-]?[0-9]+$"), whole(F.col(f"`{c}`"))).otherwise(F.col(f"`{c}`").try_cast("double").try_cast("bigint")) if kinds[c] == "bigint" else F.col(f"`{c}`").try_cast(kinds[c]) if kinds[c] == "double" else F.col(f"`{c}`")
    return body.orderBy("row_idx").select(*[cast(n).alias(n, metadata={"original": original}) for n, original in names])


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def read_workbook(spark: SparkSession, path: str, sheet: int = 0) -> DataFrame:
    """One sheet of an xlsx file as a grid (row_idx, cells, cell_kind), parsed on the driver: a sheet holds a million rows at most."""
    with zipfile.ZipFile(path) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        names = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        rows = ElementTree.fromstring(book.read(names[sheet])).findall("m:sheetData/m:row", _NS)
    out = []
    for at, row in enumerate(rows):
        cells: dict[int, tuple[str | None, str]] = {}
        for k, c in enumerate(row.findall("m:c", _NS)):
            letters = re.match(r"[A-Z]+", c.get("r", ""))
            col = k if letters is None else sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1
            kind, v = c.get("t"), c.find("m:v", _NS)
            if kind == "inlineStr":
                cells[col] = ("".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")), "text")
            elif v is not None and v.text is not None:
                cells[col] = (shared[int(v.text)], "text") if kind == "s" else (v.text, "text") if kind in ("str", "e") else ("true" if v.text == "1" else "false", "bool") if kind == "b" else (v.text, "number")
        width = max(cells, default=-1) + 1
        out.append((int(row.get("r", at + 1)) - 1, [cells.get(i, (None, "null"))[0] for i in range(width)], [cells.get(i, (None, "null"))[1] for i in range(width)]))
    return spark.createDataFrame(out, "row_idx int, cells array<string>, cell_kind array<string>")
