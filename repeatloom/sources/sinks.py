"""CSV and GFF lines as a column, and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number(c: Column) -> Column:
    """Doubles in up to 15 significant digits without trailing zeros, which the JVM's own format keeps."""

    @F.pandas_udf("string")
    def shortest(x):
        return x.map(lambda v: "" if v != v else "%.15g" % v)

    return shortest(c.cast("double"))


def csv(rows: DataFrame, keep: list[str] = ()) -> DataFrame:
    """line: strings quoted (inner quotes as they are), integers plain, doubles by number(), booleans as "TRUE" and "FALSE".
    Kept columns follow, named with a _ before."""
    cells = []
    for f in rows.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            cells.append(F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"')))
        elif isinstance(f.dataType, T.BooleanType):
            cells.append(F.when(c, F.lit('"TRUE"')).otherwise(F.lit('"FALSE"')))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cells.append(number(c))
        else:
            cells.append(c.cast("string"))
    return rows.select(F.concat_ws(",", *cells).alias("line"), *[F.col(c).alias(f"_{c}") for c in keep])


def write_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """One file under path, header first, rows by the order columns (which hold no null). The tables written here are summaries;
    larger ones are better kept as Parquet."""
    head = rows.sparkSession.createDataFrame([(",".join(f'"{c}"' for c in rows.columns),)], "line string")
    lines = csv(rows, order).unionByName(head, allowMissingColumns=True)
    # sorted within the one task that writes the file: nulls, and so the header, come first
    lines.repartition(1).sortWithinPartitions(*[F.col(f"_{c}").asc_nulls_first() for c in order]).select("line").write.mode("overwrite").text(path)


def gff(rows: DataFrame, *, seqid, source, type_, start, end, score=None, strand=None, phase=None, attributes=()) -> DataFrame:
    """line: nine tab-separated fields; each argument is a column name or a column, attributes are (label, column) pairs."""

    def field(x) -> Column:
        return F.lit(".") if x is None else (F.col(x) if isinstance(x, str) else x).cast("string")

    notes = F.concat_ws(";", *[F.concat(F.lit(label), field(c)) for label, c in attributes]) if attributes else F.lit(".")
    return rows.select(F.concat_ws("\t", *map(field, (seqid, source, type_, start, end, score, strand, phase)), notes).alias("line"))


def write_gff(lines: DataFrame, path: str) -> None:
    lines.coalesce(1).write.mode("overwrite").option("lineSep", "\r").text(path)


def fasta_text(name: Column, seq: Column) -> Column:
    """A record with lines of 60 characters."""
    return F.concat(F.lit(">"), name, F.lit("\n"), F.regexp_replace(F.regexp_replace(seq, "(.{60})", "$1\n"), "\n$", ""), F.lit("\n"))
