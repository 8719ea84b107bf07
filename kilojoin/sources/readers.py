"""Readers of measured signals: each gives long rows (record_id, idx, t, sig_id, v), record_id being the file.

CSV, ASCII and table files go line by line through Spark's text reader, which cuts large files into splits; lines are numbered within
their split and by the lines of the splits before it, so no task needs a whole file. Plot files,
whose blocks refer to each other, are read whole, one task for a file.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilojoin.operators.flow import small
from kilojoin.operators.skew import TASK

LONG = "record_id string, idx long, t double, sig_id string, v double"


def _files(spark: SparkSession, path: str) -> DataFrame:
    """record_id, text: whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("record_id"), F.col("value").alias("text"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """record_id, n (from 0), line: the lines of all files that aren't blank."""
    block = F.col("_metadata.file_block_start")
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("record_id"), block.alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    rows = rows.where(F.trim("line") != "")
    sizes = rows.groupBy("record_id", "block").agg(F.count(F.lit(1)).alias("own"))
    before = Window.partitionBy("record_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("record_id", "block", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("record_id", "block").orderBy("at")) - 1)
    return rows.join(sizes, ["record_id", "block"]).select("record_id", (F.col("nth") + F.col("before")).cast("long").alias("n"), "line")


def _cells(line: Column, sep: str) -> Column:
    """The cells of a line, trimmed; quotes may hold the separator, a doubled quote is one."""
    plain, outside = f"\\Q{sep}\\E", f'\\Q{sep}\\E(?=(?:[^"]*+"[^"]*+")*+[^"]*+$)'
    cells = F.when(line.contains('"'), F.split(line, outside, -1)).otherwise(F.split(line, plain, -1))

    def content(cell: Column) -> Column:
        cell = F.trim(cell)
        inner = F.replace(F.substr(cell, F.lit(2), F.greatest(F.length(cell) - 2, F.lit(0))), F.lit('""'), F.lit('"'))
        return F.when(cell.startswith('"') & cell.endswith('"') & (F.length(cell) > 1), inner).otherwise(cell)

    return F.transform(cells, content)


def _with_header(rows: DataFrame, sep: str) -> DataFrame:
    """record_id, idx (from 0, below the header), names, cells."""
    rows = rows.select("record_id", "n", _cells(F.col("line"), sep).alias("cells"))
    heads = rows.where("n = 0").select("record_id", F.col("cells").alias("names"))
    return rows.where("n > 0").join(heads, "record_id").select("record_id", (F.col("n") - 1).alias("idx"), "names", "cells")


def _lines(text: str) -> list[str]:
    return [x for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip()]


def _read(files: DataFrame, parse) -> DataFrame:
    """Rows of what parse gives of each text, names and rows with the time first; many short files make one batch."""
    columns = ["record_id", "idx", "t", "sig_id", "v"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"idx": "int64", "t": "float64", "v": "float64"})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for record, text in zip(batch["record_id"], batch["text"], strict=True):
                names, table = parse(text)
                rows += [(record, i, r[0], s, v) for i, r in enumerate(table) for s, v in zip(names, r[1:], strict=True)]
                if len(rows) >= 50_000:
                    yield frame(rows)
                    rows = []
        yield frame(rows)

    return files.mapInPandas(each, LONG)


def read_modelica_csv(spark: SparkSession, path: str) -> DataFrame:
    """Comma CSV whose first header is "time"; the last column is a dummy and goes; empty cells are 0. Rows of other lengths are an error."""
    rows = _with_header(_numbered(spark, path), ",")
    wrong = F.when(F.get("names", F.lit(0)) != "time", F.raise_error(F.lit("the first column must be time")))
    wrong = wrong.when(F.size("cells") != F.size("names"), F.raise_error(F.lit("a row has another length than the header")))
    numbers = F.transform(F.when(F.isnull(wrong), F.col("cells")), lambda c: F.when(c == "", 0.0).otherwise(c.cast("double")))
    rows = rows.select("record_id", "idx", "names", numbers.alias("c"))
    picked = F.arrays_zip(F.slice("names", F.lit(2), F.size("names") - 2).alias("s"), F.slice("c", F.lit(2), F.size("names") - 2).alias("v"))
    return rows.select("record_id", "idx", F.get("c", F.lit(0)).alias("t"), F.explode(picked).alias("x")).select("record_id", "idx", "t", F.col("x.s").alias("sig_id"), F.col("x.v").alias("v"))


def read_columns_csv(spark: SparkSession, path: str, columns: Sequence[int], where: Column | None = None, sep: str = ";") -> DataFrame:
    """Separated file with a header: the columns at these places (the first one is the time), for rows that satisfy ``where`` (over c0, c1, ...)."""
    numbers = F.transform("cells", lambda c: F.replace(c, F.lit(","), F.lit(".")).try_cast("double"))
    rows = _with_header(_numbered(spark, path), sep).select("record_id", "idx", "names", numbers.alias("cells"))
    if where is not None:
        rows = rows.withColumns({f"c{i}": F.get("cells", F.lit(i)) for i in range(max([*columns, 0]) + 1)}).where(where)
    picked = F.array(*[F.struct(F.get("names", F.lit(i)).alias("s"), F.get("cells", F.lit(i)).alias("v")) for i in columns[1:]])
    rows = rows.select("record_id", "idx", F.get("cells", F.lit(columns[0])).alias("t"), F.explode(picked).alias("x"))
    return rows.select("record_id", "idx", "t", F.col("x.s").alias("sig_id"), F.col("x.v").alias("v"))


def read_typed_csv(spark: SparkSession, path: str, schema: str, sep: str = ";") -> DataFrame:
    """Separated file with a header and a schema; cells that don't fit are an error."""
    return spark.read.csv(path, schema=schema, sep=sep, header=True, mode="FAILFAST", quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def read_structured_csv(spark: SparkSession, path: str, fields: Sequence[tuple[str, int]], sep: str = ";") -> DataFrame:
    """record_id, idx, and each field (name, number of cells) as an array of its cells, of a separated file with a header; a row of another length is an error."""
    size = sum(n for _, n in fields)
    rows = _with_header(_numbered(spark, path), sep)
    cells = F.when(F.size("cells") == size, F.col("cells")).otherwise(F.raise_error(F.lit(f"a row has not {size} cells")).cast("array<string>"))
    rows, at, out = rows.select("record_id", "idx", cells.alias("cells")), 1, []
    for name, n in fields:
        out.append(F.slice("cells", at, n).alias(name))
        at += n
    return rows.select("record_id", "idx", *out)


def read_modelica_ascii(spark: SparkSession, path: str) -> DataFrame:
    """Blank-separated numbers without a header, time first; the last column is a dummy and goes; signals are sig_0, sig_1, ..."""
    numbers = F.transform(F.split(F.trim("line"), r"\s+"), lambda c: c.cast("double"))
    rows = _numbered(spark, path).select("record_id", F.col("n").alias("idx"), numbers.alias("c"))
    rows = rows.select("record_id", "idx", F.get("c", F.lit(0)).alias("t"), F.posexplode(F.slice("c", F.lit(2), F.greatest(F.size("c") - 2, F.lit(0)))).alias("i", "v"))
    return rows.select("record_id", "idx", "t", F.concat(F.lit("sig_"), F.col("i").cast("string")).alias("sig_id"), "v")


def read_plt(spark: SparkSession, path: str) -> DataFrame:
    """Plot files: a preamble up to a blank line, "DataSet: time", then blocks "DataSet: name" of "x, y" lines, of which y counts.

    A file may hold several plots, each of which begins with a line "Title: ..."; those after the first are records of their own, <file>#1, <file>#2, ...
    """

    def parse(text: str):
        blocks: dict[str, list[float]] = {}
        name = None
        for line in text.partition("\n\n")[2].split("\n"):
            if line.startswith("DataSet:"):
                name = line.partition(":")[2].strip()
                blocks[name] = []
            elif name is not None and "," in line:
                blocks[name].append(float(line.split(",")[1]))
        time = blocks.pop("time")
        if any(len(v) != len(time) for v in blocks.values()):
            raise ValueError("a data set has another length than time")
        return list(blocks), [list(r) for r in zip(time, *blocks.values(), strict=True)]

    own = F.regexp_replace("text", "\r\n?", "\n")
    plots = _files(spark, path).select("record_id", F.posexplode(F.split(own, r"(?<=\n)(?=Title:)")).alias("nth", "text"))
    return _read(plots.select(F.when(F.col("nth") == 0, F.col("record_id")).otherwise(F.concat_ws("#", "record_id", "nth")).alias("record_id"), "text"), parse)


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """file, table, row, col, v of Modelica table files: "double name(rows,cols)", numbers, # comments; many tables a file.

    Files are read by splits: numbers are counted within a split's tables, and what the splits before hold of a table is added. A head with the comment
    "rows from n" is a piece of a table (write_tables), whose first row is n. Another number of numbers than rows x cols is an error.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    line = F.trim(F.regexp_replace(F.split_part("value", F.lit("#"), F.lit(1)), r"\s+", " "))
    part = lambda i: F.regexp_extract(line, r"^double ?([^(]*)\(([^,]*),([^)]*)\)(.*)$", i)
    head, start = line.startswith("double"), F.regexp_extract("value", r"# rows from (\d+)", 1)
    whole = lambda c: F.trim(c).cast("long")
    size = F.when(head, F.struct(F.trim(part(1)).alias("table"), whole(part(2)).alias("rows"), whole(part(3)).alias("cols"), F.when(start != "", start.cast("long")).otherwise(0).alias("start")))
    numbers = F.transform(F.filter(F.split(F.when(head, part(4)).otherwise(line), " "), lambda x: x != ""), lambda x: x.cast("double"))
    rows = text.select("file", "block", "at", size.alias("head"), numbers.alias("x")).where("head is not null or size(x) > 0")
    rows = rows.withColumn("nth", F.count("head").over(Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy("file", "block", "nth").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum(F.size("x")).over(before), F.lit(0)))

    parts = rows.groupBy("file", "block", "nth").agg(F.max("head").alias("head"), F.sum(F.size("x")).alias("n"))
    order = Window.partitionBy("file").orderBy("block", "nth").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("no", F.count("head").over(order)).where("no > 0")  # numbers before the first table are none's
    table = Window.partitionBy("file", "no")
    so_far = table.orderBy("block", "nth").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("file", "block", "nth", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"), F.max("head").over(table).alias("t"), F.sum("n").over(table).alias("all"))
    wrong = F.concat(F.lit("table "), F.col("t.table"), F.lit(" has "), F.col("all"), F.lit(" numbers, not "), F.col("t.rows"), F.lit(" x "), F.col("t.cols"))
    parts = parts.where(F.when(F.col("all") != F.col("t.rows") * F.col("t.cols"), F.raise_error(wrong).isNull()).otherwise(True))
    found = rows.join(small(parts), ["file", "block", "nth"]).select("file", "t", (F.col("before") + F.col("own")).alias("i"), F.posexplode("x").alias("pos", "v"))
    at = F.col("i") + F.col("pos")
    row = F.col("t.start") + F.floor(at / F.col("t.cols"))
    return found.select("file", "t.table", row.cast("int").alias("row"), F.pmod(at, F.col("t.cols")).cast("int").alias("col"), "v")


def parse_tables(text: str) -> list[tuple[str, int, int, float]]:
    out, name, size, numbers = [], None, (0, 0), []

    def close() -> None:
        if name is not None:
            rows, cols = size
            if len(numbers) != rows * cols:
                raise ValueError(f"table {name} has {len(numbers)} numbers, not {rows} x {cols}")
            out.extend((name, i // cols, i % cols, x) for i, x in enumerate(numbers))

    for line in _lines(text):
        line = line.partition("#")[0].strip()
        if line.startswith("double"):
            close()
            name, _, rest = line[6:].strip().partition("(")
            name, numbers = name.strip(), []
            size = tuple(int(x) for x in rest.partition(")")[0].split(","))
            line = rest.partition(")")[2]
        numbers += [float(x) for x in line.split()] if name is not None else []
    close()
    return out


def write_tables(tables: DataFrame, path: str, piece: int = TASK) -> None:
    """Tables (table, row from 0, col, v) in the format that read_tables reads; one of more than ``piece`` rows in pieces, each under a head with its first row."""
    rows = tables.groupBy("table", "row").agg(F.array_sort(F.collect_list(F.struct("col", "v"))).alias("c"))
    line = F.array_join(F.transform("c", lambda x: x["v"].cast("string")), " ")
    rows = rows.select("table", F.floor(F.col("row") / piece).alias("piece"), "row", F.size("c").alias("n"), line.alias("line"))
    size = rows.groupBy("table", "piece").agg(F.count(F.lit(1)).alias("many"), F.max("n").alias("n"))
    note = F.when(F.col("piece") > 0, F.concat(F.lit(" # rows from "), F.col("piece") * piece)).otherwise("")
    head = F.concat(F.lit("double "), F.col("table"), F.lit("("), F.col("many"), F.lit(","), F.col("n"), F.lit(")"), note)
    lines = rows.select("table", "piece", "row", "line").unionByName(size.select("table", "piece", F.lit(-1).alias("row"), head.alias("line")))
    lines.repartition("table", "piece").sortWithinPartitions("table", "piece", "row").select("line").write.text(path)


def curve(tables: DataFrame) -> DataFrame:
    """table, row, x, curve, y: the first column is the axis, each other column a curve."""
    x = tables.where("col = 0").select("table", "row", F.col("v").alias("x"))
    return tables.where("col > 0").join(x, ["table", "row"]).select("table", "row", "x", F.col("col").alias("curve"), F.col("v").alias("y"))


def surface(tables: DataFrame) -> DataFrame:
    """table, x, y, z: the first column and the first row are the axes."""
    x = tables.where("col = 0 and row > 0").select("table", "row", F.col("v").alias("x"))
    y = tables.where("row = 0 and col > 0").select("table", "col", F.col("v").alias("y"))
    return tables.where("row > 0 and col > 0").join(x, ["table", "row"]).join(y, ["table", "col"]).select("table", "x", "y", F.col("v").alias("z"))


def transposed(tables: DataFrame) -> DataFrame:
    return tables.withColumns({"row": F.col("col"), "col": F.col("row")})


def power_signals(tables: DataFrame, names: Sequence[str]) -> DataFrame:
    """Named tables (time, power) as signals of one record."""
    rows = curve(tables.where(F.col("table").isin(*names))).where("curve = 1")
    return rows.select(F.lit("tables").alias("record_id"), F.col("row").cast("long").alias("idx"), F.col("x").alias("t"), F.col("table").alias("sig_id"), F.col("y").alias("v"))
