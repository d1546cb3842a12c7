"""Tables from Parquet folders, and results to files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table's name in a statement's text: {lineitem}.
PLACE = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table. Filters and columns reach the Parquet scan through the plan; nothing is read here."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, name) for name in names]


def statement(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A SQL statement whose tables are written {name}, over the tables of a folder; no view outlives it."""
    return spark.sql(text, **{name: table(spark, sf_dir, name) for name in sorted(set(PLACE.findall(text)))})


def bare(text: str) -> str:
    """The statement with plain table names."""
    return PLACE.sub(r"\1", text)


def csv_line(frame: DataFrame, null: str = "", delimiter: str = ",") -> Column:
    """A row as a line of COPY's CSV: booleans as t and f, quotes where a field has a quote, a delimiter or a line end, or is what stands for null."""
    fields = []
    for f in frame.schema.fields:
        text = F.when(F.col(f.name), "t").otherwise("f") if f.dataType.simpleString() == "boolean" else F.col(f.name).cast("string")
        odd = text.rlike(f'["\r\n{re.escape(delimiter)}]') | (text == null)
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        fields.append(F.when(F.col(f.name).isNull(), null).when(odd, quoted).otherwise(text))
    return F.concat_ws(delimiter, *fields)


def copy_to_csv(frame: DataFrame, path: str, header: bool = False, null: str = "", delimiter: str = ",") -> None:
    """Writes rows as CSV files of the lines that `csv_line` tells: null as an empty unquoted field."""
    shown = frame.select(*(F.when(F.col(f.name), "t").when(~F.col(f.name), "f").alias(f.name) if f.dataType.simpleString() == "boolean" else F.col(f.name) for f in frame.schema.fields))
    shown.write.mode("overwrite").csv(path, header=header, sep=delimiter, nullValue=null, emptyValue='""', quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
