"""Reading and writing files and nested payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_path


def this_century(day):
    """A date read from two digits of its year, which mean 1970 to 2069."""
    return F.when(F.year(day) >= 2070, F.add_months(day, -1200)).otherwise(day)


def soccer_rows(lines: DataFrame) -> DataFrame:
    """game_id, game_date, ftr from CSV lines (column value): two date formats, bad results dropped."""
    r = lines.select(F.from_csv("value", "game_id bigint, day string, ftr string").alias("r")).select("r.*")
    four = F.col("day").rlike(r"^\d{2}/\d{2}/\d{4}$")
    day = F.coalesce(F.when(four, F.try_to_timestamp("day", F.lit("dd/MM/yyyy"))), F.when(~four, F.try_to_timestamp("day", F.lit("dd/MM/yy"))))
    day = F.when(four, day.cast("date")).otherwise(this_century(day.cast("date")))
    return r.select("game_id", day.alias("game_date"), "ftr").where(F.col("game_date").isNotNull() & F.col("ftr").isin("H", "D", "A"))


def scoreboard_rows(docs: DataFrame) -> DataFrame:
    """game_id and both scores from nested scoreboards (column value)."""
    e = docs.select(F.explode(F.from_json("value", "events array<struct<id bigint, teams array<struct<side string, score bigint>>>>")["events"]).alias("e"))
    scores = F.map_from_entries(F.col("e.teams"))
    return e.select(F.col("e.id").alias("game_id"), scores["home"].alias("home_score"), scores["away"].alias("away_score"))


def odds_rows(docs: DataFrame) -> DataFrame:
    """market, name, price: one row an outcome of a bookmaker's feed (column value)."""
    feed = F.from_json("value", "bookmakers array<struct<outcomes array<struct<name string, price double>>>>")["bookmakers"]
    return docs.select("market", F.explode(feed).alias("b")).select("market", F.explode("b.outcomes").alias("o")).select("market", "o.*")


def csv_tree(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """All CSV files below a path with their path as ``file``; broken lines dropped."""
    read = spark.read.option("encoding", encoding).option("mode", "DROPMALFORMED").option("header", header).option("recursiveFileLookup", True)
    return read.csv(path, schema=schema).withColumn("file", F.col("_metadata.file_path"))


def csv_or_torn(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, broken lines with their text as ``line`` and their path as ``file``) of all UTF-8 CSV lines below a path, without headers; each line is in one of the two."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    read = lines.select(F.from_csv("value", f"{schema}, _line string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line"}).alias("r"), "file").select("r.*", "file")
    return read.where("_line is null").drop("_line", "file"), read.where("_line is not null").select(F.col("_line").alias("line"), "file")


def csv_any_encoding(spark: SparkSession, path: str, schema: str, encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> DataFrame:
    """CSV files below a path, each in the first of the encodings that it is valid in (the last one takes what is left)."""
    bad = F.concat_ws("", "*").contains("\ufffd")  # what a decoder puts for bytes that it can't read
    out, left = None, None
    for i, encoding in enumerate(encodings):
        rows = csv_tree(spark, path, schema, encoding)
        rows = rows if left is None else rows.join(left, "file", "left_semi")
        if i + 1 < len(encodings):
            left = rows.where(bad).select("file").distinct()
            rows = rows.join(left, "file", "left_anti")
        out = rows if out is None else out.unionByName(rows)
    return out


def jdbc_options(url: str, table: str, columns: list[str], where: dict[str, object] | None = None, split: str | None = None, bounds: tuple | None = None, partitions: int = 1, **more: str) -> dict[str, str]:
    """Options of ``spark.read.format("jdbc")``: the filter goes to the server with the query, the rest is read in ranges of ``split``.

    where: column -> value, or -> (operator, value).  Values are quoted, never taken as SQL; other operators are refused.
    """

    def literal(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    def name(c: str) -> str:
        return '"' + c.replace('"', '""') + '"'

    terms = []
    for column, value in (where or {}).items():
        op, v = value if isinstance(value, tuple) else ("=", value)
        if op not in ("=", "<>", "<", "<=", ">", ">="):
            raise ValueError(f"unknown operator {op!r}")
        terms.append(f"{name(column)} IS NULL" if v is None and op == "=" else f"{name(column)} {op} {literal(v)}")
    query = f"SELECT {', '.join(map(name, columns))} FROM {name(table)}" + (" WHERE " + " AND ".join(terms) if terms else "")
    out = {"url": url, "dbtable": f"({query}) AS q", "fetchsize": "10000", **more}
    if split:
        low, high = bounds
        out |= {"partitionColumn": split, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(partitions)}
    return out


def through_csv(df: DataFrame, schema: str) -> DataFrame:
    """df written as CSV and read back."""
    path = shared_path(df.sparkSession, "export")
    df.write.option("header", True).csv(path)
    return df.sparkSession.read.option("header", True).csv(path, schema=schema)


def appended(frames: list[DataFrame]) -> DataFrame:
    """Frames appended to one table, one after another, as it reads then."""
    path = shared_path(frames[0].sparkSession, "table")
    for f in frames:
        f.write.mode("append").parquet(path)
    return frames[0].sparkSession.read.parquet(path)
