from pyspark.sql import functions as F

from corpusmill.functions.records import CPT, as_records, metadata, position


def texts(spark, values, *, scope=None):
    """Text records in the order given, optionally with a scope column."""
    rows = [(i, value, scope[i] if scope else "s") for i, value in enumerate(values)]
    df = spark.createDataFrame(rows, "n bigint, t string, scope string")
    where = metadata(F.col("n"), F.lit("file.txt"), F.lit("hash"))
    return as_records(df, CPT, "scope", ord=position(F.col("n")), text=F.col("t"), metadata=where)


def numbers(df):
    """Source positions of records, sorted."""
    return sorted(row.ord >> 28 for row in df.select("ord").collect())
