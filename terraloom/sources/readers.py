"""File readers whose columns are found by role, and writers of documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Header patterns of the roles that staged files have.
ROLES = {"company": r"company|employer|organi[sz]ation|issuer|exporter|importer|trader", "date": r"date|effective|received", "value": r"value|amount|volume|employees|number|penalty"}


def roles_of(columns: list[str], roles: dict[str, str] = ROLES) -> dict[str, list[str]]:
    """Columns of each role, by a pattern over the header, in file order."""
    return {role: [c for c in columns if re.search(pattern, c, re.I)] for role, pattern in roles.items()}


def by_roles(df: DataFrame, roles: dict[str, str] = ROLES) -> DataFrame:
    """One string column per role: the first of its columns that isn't blank; null where a role has none."""
    found = roles_of(df.columns, roles)
    pick = lambda names: F.coalesce(*[F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names]) if names else F.lit(None).cast("string")
    return df.select(*[pick(names).alias(role) for role, names in found.items()])


def read_csv_set(spark: SparkSession, paths: list[str], header: bool = True) -> DataFrame:
    """Files that may differ in columns, as one table with the file each row came from."""
    parts = [spark.read.csv(p, header=header).withColumn("source_file", F.input_file_name()) for p in paths]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that aren't of the schema are dropped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_markdown_names(spark: SparkSession, path: str) -> DataFrame:
    """First cells of the rows of a pipe table, without its header and rule."""
    lines = spark.read.text(path).where(F.col("value").startswith("|") & ~F.col("value").rlike(r"^\|[\s:|-]+$"))
    names = lines.select(F.trim(F.split("value", r"\|")[1]).alias("name"))
    return names.where(~F.lower("name").isin("name", "market") & (F.col("name") != ""))


def write_documents(df: DataFrame, path: str, key: str) -> None:
    """A JSON document per row, in files by key."""
    df.select(key, F.to_json(F.struct(*df.columns)).alias("value")).write.partitionBy(key).mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, mode="overwrite")
