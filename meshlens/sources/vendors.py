"""Vendor-prefix file: ``prefix[/bits] <TAB> short [<TAB> long]`` per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from meshlens.functions.macs import hex_digits
from meshlens.functions.text import not_empty, split_lines, strip, to_int

DEFAULT_BITS = 24
SCHEMA = "bits int, prefix string, vendor string"


def parse_vendor_lines(lines: DataFrame) -> DataFrame:
    """``(line_no, line)`` to ``(bits, prefix, vendor)``; of equal prefixes the last line wins.

    Skipped: blank and comment lines, lines without a tab, without a vendor, with a mask that
    is no number, or with fewer digits than the mask asks for.
    """
    cells = lines.where("line != '' AND line NOT LIKE '#%' AND contains(line, '\t')").select(
        "line_no", F.split("line", "\t").alias("cell")
    )
    named = cells.select(
        "line_no",
        F.expr(f"substring_index({strip('cell[0]')}, '/', 1)").alias("address"),
        F.expr("contains(cell[0], '/')").alias("masked"),
        F.expr(
            to_int(f"substring({strip('cell[0]')}, instr({strip('cell[0]')}, '/') + 1)")
        ).alias("mask"),
        F.expr(
            f"coalesce({not_empty(strip('get(cell, 2)'))}, {not_empty(strip('cell[1]'))})"
        ).alias("vendor"),
    )
    entries = named.selectExpr(
        "line_no",
        f"IF(masked, mask, {DEFAULT_BITS}) AS bits",
        f"{hex_digits('address')} AS digits",
        "vendor",
    ).where("vendor IS NOT NULL AND bits >= 0 AND length(digits) >= bits div 4")
    return (
        entries.withColumn("prefix", F.expr("left(digits, int(bits div 4))"))
        .groupBy("bits", "prefix")
        .agg(F.max_by("vendor", "line_no").alias("vendor"))
    )


def read_vendor_file(spark: SparkSession, path: str) -> DataFrame:
    """Vendor file as a table; a missing file is no error, it just knows no vendor."""
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)
    lines = files.select(F.posexplode(F.expr(split_lines("value"))).alias("line_no", "line"))
    return parse_vendor_lines(lines)
