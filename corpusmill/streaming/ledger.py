"""A persistent set of keys, so that later batches know what earlier ones had.

Keys are 16-byte digests.  The ledger is a folder ``batch=N/prefix=P`` of Parquet files; a key's prefix
is a number from its hash.  A batch looks its keys up in the folders of its own prefixes
only, and of earlier batches only.  Each batch has one folder, which is replaced as a whole, so a batch
that is repeated after a failure changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# More of them read less for a small batch and write more files for a large one.
PREFIXES = 32


@dataclass(frozen=True)
class KeyLedger:
    path: str
    prefixes: int = PREFIXES

    def _prefix(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.prefixes)).cast("int")

    def add(self, keys: DataFrame, batch: int) -> None:
        """The different keys of ``keys``, (key), as those of ``batch``."""
        own = keys.select("key").distinct().withColumn("prefix", self._prefix())
        own.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{self.path}/batch={batch}")

    def _earlier(self, rows: DataFrame, batch: int) -> DataFrame | None:
        """(key) of earlier batches below the prefixes of ``rows``, of which there are ``prefixes`` at most."""
        spark = rows.sparkSession
        wanted = [r.prefix for r in rows.select(self._prefix().alias("prefix")).distinct().collect()]
        try:
            stored = spark.read.schema("key binary, batch bigint, prefix int").option("basePath", self.path).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return stored.where((F.col("batch") < batch) & F.col("prefix").isin(wanted)).select("key")

    def known(self, rows: DataFrame, batch: int) -> DataFrame:
        """The rows of a written table (key, ...) whose key an earlier batch had."""
        earlier = self._earlier(rows, batch)
        return rows.limit(0) if earlier is None else rows.join(earlier, "key", "left_semi")

    def unknown(self, rows: DataFrame, batch: int) -> DataFrame:
        """The other rows."""
        earlier = self._earlier(rows, batch)
        return rows if earlier is None else rows.join(earlier, "key", "left_anti")


