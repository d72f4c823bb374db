"""File sources: customer CSV files and the upload landing folder.

Every column is read as STRING (no inference) and cast explicitly later, so
bad values are detected instead of silently nulled.  Spark's CSV reader
strips a UTF-8 BOM and CRLF line ends.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S

CSV_GLOB = "*.[cC][sS][vV]"
# upload names look like YYYYMMDD_HHMMSS_<label>.csv; Spark-written uploads
# carry the same name on their folder
LANDING_NAME = r"(\d{8}_\d{6})_([^/]+?)(\.[cC][sS][vV])?(/[^/]*)?$"
UPLOAD_INFO = ["source_file", "arrival_ts", "upload_label"]
_PAIR = "\x01"  # stands for two quotes in a row while a line is split; a line that holds it itself is not plain


def read_customer_csv(spark: SparkSession, path: str) -> DataFrame:
    """A1: header CSV, all columns STRING."""
    return (spark.read.option("header", True).option("inferSchema", False)
            .option("mode", "PERMISSIVE").csv(path))


def read_landing(spark: SparkSession, folder: str) -> DataFrame:
    """A3: every ``.csv`` below ``folder`` (extension case-insensitive), with its
    upload time and label parsed from the file (or folder) name; see :func:`bind_by_name`."""
    return bind_by_name(landing_lines(spark.read, folder))


def landing_reader(reader):
    """A batch or stream reader of upload files, header lines as rows."""
    return reader.option("header", False).option("pathGlobFilter", CSV_GLOB).option("recursiveFileLookup", True)


def landing_lines(reader, folder) -> DataFrame:
    """The lines of upload files (``value``) with their upload's info."""
    return with_upload_info(landing_reader(reader).text(folder)).filter(F.trim("value") != "")


def _well_formed(line) -> F.Column:
    """Whether a line is whole records' worth of fields: quotes only around fields, and doubled inside them."""
    paired = F.concat(F.lit(","), F.replace(line, F.lit('""'), F.lit(_PAIR)))
    return ~F.contains(F.regexp_replace(paired, ',"[^"]*"(?=,|$)', ","), F.lit('"')) & ~F.contains(line, F.lit(_PAIR))


def _split(line) -> F.Column:
    """The fields of a well-formed line, however many; an absent value is NULL."""
    paired = F.concat(F.lit(","), F.replace(line, F.lit('""'), F.lit(_PAIR)))

    def field(x):
        quoted = F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit(_PAIR), F.lit('"'))
        return F.when(x == _PAIR, F.lit("")).when(x.startswith('"'), quoted).when(
            x != "", F.replace(x, F.lit(_PAIR), F.lit('""')))
    return F.transform(F.regexp_extract_all(paired, F.lit(',("[^"]*"|[^,"]*)'), F.lit(1)), field)


def upload_records(lines: DataFrame) -> DataFrame:
    """One row per record of the uploads whose lines are given: ``_fields`` (array) and the upload's info.

    A file whose lines are all well formed is split line by line, so a large one is spread over tasks.  A file in
    which some line is not (a quoted field with line breaks, a stray quote) is read by Spark's own parser, a task a
    file, with as many columns as the widest header line.  Their names reach the driver, which lists all files anyway.
    """
    spark = lines.sparkSession
    names = [F.contains("value", F.lit(n)).cast("int") for n in S.REQUIRED_PUBLIC]
    width = F.size(F.split("value", ","))
    odd = (lines.groupBy("source_file").agg(
        F.bool_or(~_well_formed(F.col("value"))).alias("odd"), F.max(width).alias("width"),
        F.max(F.when(sum(names, F.lit(0)) >= 2, width)).alias("header")).filter("odd").collect())
    plain = lines if not odd else lines.filter(~F.col("source_file").isin([r["source_file"] for r in odd]))
    out = plain.select(*UPLOAD_INFO, _split(F.col("value")).alias("_fields"))
    if not odd:
        return out
    columns = max(r["header"] or 0 for r in odd) + 1
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(max(columns, len(S.REQUIRED_PUBLIC)))])
    paths = [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(r["source_file"])) for r in odd]
    parsed = with_upload_info(spark.read.schema(schema).option("multiLine", True).option("escape", '"')
                              .option("maxColumns", max(20_480, 4 * max(r["width"] for r in odd))).csv(paths))
    return out.unionByName(parsed.select(*UPLOAD_INFO, F.array(*schema.fieldNames()).alias("_fields")))


def bind_by_name(lines: DataFrame) -> DataFrame:
    """The required columns of the uploads whose lines are given, each file by its own header line.

    A header line is one with at least two required names.  Column order, extra
    columns and the case of several files with different headers do not matter.
    Rows of a file without a header, or whose header lacks a required column, have
    the absent names in ``missing_columns`` (NULL elsewhere) for the quarantine.
    One header row per file is joined to its rows without a hint: broadcast if small, and
    a file that holds most rows is a skewed partition that the planner splits.
    """
    names = F.array(*[F.lit(n) for n in S.REQUIRED_PUBLIC])
    clean = F.transform("_fields", lambda x: F.trim(F.regexp_replace(x, "^\ufeff", "")))
    rows = upload_records(lines).withColumn("_clean", clean)
    rows = rows.withColumn("_header", F.size(F.array_intersect("_clean", names)) >= 2)
    headers = rows.filter("_header").groupBy("source_file").agg(F.min("_clean").alias("_names"))
    both = rows.filter("not _header").drop("_clean").join(headers, "source_file", "left")
    missing = F.array_except(names, F.coalesce("_names", F.array().cast("array<string>")))
    found = [F.get("_fields", F.array_position("_names", n).cast("int") - 1).alias(n) for n in S.REQUIRED_PUBLIC]
    return both.select(*found, *UPLOAD_INFO, F.when(F.size(missing) > 0, F.array_join(missing, ", ")).alias("missing_columns"))


def with_upload_info(df: DataFrame, path_col: str = "_metadata.file_path") -> DataFrame:
    p = F.col(path_col)
    stamp = F.regexp_extract(p, LANDING_NAME, 1)
    label = F.replace(F.regexp_extract(p, LANDING_NAME, 2), F.lit("+"), F.lit("%2B"))  # a path is a URI, in which + stands for itself
    return (df.withColumn("source_file", p)
            .withColumn("arrival_ts", F.when(stamp != "", F.to_timestamp_ntz(stamp, F.lit("yyyyMMdd_HHmmss"))))
            .withColumn("upload_label", F.url_decode(label)))
