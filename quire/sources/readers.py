"""Reading stored records with explicit schemas, tolerant of broken rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = "id string, ts long, kind string, message string, stack string, stage string, platform string, app_version string, uid string, email string, source string"


def json_lines(spark: SparkSession, path: str, schema: str = EVENT, required: str = "id") -> DataFrame:
    """One record per line; blank, malformed and id-less lines are passed over."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", T._parse_datatype_string(schema), {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return rows.where(F.col(required).isNotNull() & (F.trim(required) != ""))


def source_kind(filename: Column) -> Column:
    """pdf, docx, or null by extension."""
    low = F.lower(F.trim(filename))
    return F.when(low.endswith(".pdf"), "pdf").when(low.endswith(".docx"), "docx")


def image_mime(content: Column, declared: Column) -> Column:
    """Image type by the declared type, else by the first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    sniffed = (
        F.when(head.startswith("89504E47"), "image/png")
        .when(head.startswith("FFD8"), "image/jpeg")
        .when(head.startswith("474946"), "image/gif")
        .when(head.startswith("52494646") & F.contains(head, F.lit("57454250")), "image/webp")
        .when(head.startswith("424D"), "image/bmp")
    )
    return F.when(F.coalesce(declared, F.lit("")).startswith("image/"), F.split(declared, ";")[0]).otherwise(F.coalesce(sniffed, F.lit("application/octet-stream")))


def data_url(content: Column, mime: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def data_url_bytes(url: Column) -> Column:
    """Bytes of a base64 data URL; null for anything else."""
    return F.when(url.rlike(r"^data:[^;,]*;base64,[A-Za-z0-9+/=\s]*$"), F.unbase64(F.substring_index(url, ",", -1)))


def table_text(rows: Column) -> Column:
    """Cells of each row with ` | ` between, one row a line."""
    return F.array_join(F.transform(rows, lambda cells: F.array_join(F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit("")))), " | ")), "\n")
