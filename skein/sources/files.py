"""Files in and out: messages as CSV, threads as JSON lines, small reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.messages import cast_messages

MESSAGE_COLUMNS = ("tweet_id", "author_id", "inbound", "created_at", "text", "response_tweet_id", "in_response_to_tweet_id")
MESSAGES_RAW = T.StructType([T.StructField(c, T.StringType()) for c in MESSAGE_COLUMNS])
#: What stands for null in the CSV of :func:`write_csv`.
NULL = "\\N"
#: As the raw files write a time; the weekday cannot be parsed back, so it is skipped on reading.
TIME_FORMAT = "E MMM dd HH:mm:ss Z yyyy"


def read_messages_csv(spark: SparkSession, path: str) -> DataFrame:
    """Messages from CSV with a header, quoted line breaks and doubled quotes; all columns read as strings, then cast."""
    return cast_messages(spark.read.schema(MESSAGES_RAW).csv(path, header=True, multiLine=True, escape='"', quote='"'))


def write_messages_csv(rows: DataFrame, path: str) -> None:
    inbound = F.when(F.col("inbound"), "True").when(~F.col("inbound"), "False")
    out = rows.select(*MESSAGE_COLUMNS).withColumns({"inbound": inbound, "created_at": F.date_format("created_at", TIME_FORMAT)})
    out.write.csv(path, header=True, escape='"', quote='"', emptyValue='""', nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_csv(rows: DataFrame, path: str) -> None:
    """Any flat table as CSV with a header: nulls as ``\\N``, empty texts quoted, so that both come back."""
    rows.write.csv(path, header=True, escape='"', quote='"', emptyValue='""', nullValue=NULL, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table of :func:`write_csv`."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', quote='"', emptyValue="", nullValue=NULL, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, message: str | None = None) -> DataFrame:
    """JSON lines by a schema; with ``message`` only rows whose message is not blank."""
    rows = spark.read.schema(schema).json(path)
    return rows if message is None else rows.where(F.trim(message) != "")


def one_row_json(rows: DataFrame) -> DataFrame:
    """A one-row report as (json)."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def markdown_table(rows: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """(markdown) of a small result, as one text: a report's table."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    keys = F.struct(*order, line.alias("_line"))
    lines = F.transform(F.array_sort(F.collect_list(keys)), lambda x: x["_line"])
    return rows.agg(F.concat(F.lit(head), F.array_join(lines, "\n")).alias("markdown"))


def report(title: str, sections: list[tuple[str, DataFrame]]) -> DataFrame:
    """(markdown): a report of headed sections, each a one-row table (markdown) of :func:`markdown_table` or any one text."""
    out = None
    for head, body in sections:
        one = body.select(F.concat(F.lit(f"## {head}\n\n"), F.coalesce(body[body.columns[0]].cast("string"), F.lit(""))).alias("part"))
        out = one.select(F.concat(F.lit(f"# {title}\n\n"), F.col("part")).alias("markdown")) if out is None else out.join(F.broadcast(one)).select(F.concat("markdown", F.lit("\n\n"), "part").alias("markdown"))
    return out


def xml_escaped(c: Column) -> Column:
    """A text as the value of an XML attribute."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def choices_xml(names: DataFrame, name: str = "name") -> DataFrame:
    """(xml): one choice per label, for an annotation tool, in the labels' order."""
    return names.agg(F.array_join(F.transform(F.array_sort(F.collect_list(name)), lambda x: F.concat(F.lit('<Choice value="'), xml_escaped(x), F.lit('"/>'))), "\n").alias("xml"))
