"""Extracted documents, kept by content and extractor version.

A cache row carries source_hash, extractor_version and variant: 'remote',
'local', or 'fallback' (a local extraction made because a remote one failed).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import materialize

KEY = ("source_hash", "extractor_version")

# Stored variants by preference, per mode of extraction.
PREFERENCE = {"remote": ("remote", "local"), "local": ("local",), "remote_failed": ("remote", "local", "fallback")}


def _rank(variant: Column, mode: str) -> Column:
    rank = F.lit(None).cast("int")
    for at, name in reversed(list(enumerate(PREFERENCE[mode]))):
        rank = F.when(variant == name, F.lit(at)).otherwise(rank)
    return rank


def best_variant(cache: DataFrame, mode: str = "local") -> DataFrame:
    """The preferred stored variant of each content, as a pre-aggregated minimum
    over its at most three variants."""
    ranked = cache.withColumn("_rank", _rank(F.col("variant"), mode)).where("_rank IS NOT NULL")
    best = ranked.groupBy(*KEY).agg(F.min("_rank").alias("_rank"))
    return ranked.join(best, [*KEY, "_rank"], "left_semi").drop("_rank")


def missing(documents: DataFrame, cache: DataFrame, version: str, mode: str = "local") -> DataFrame:
    """Documents with no usable stored extraction, each content once."""
    stored = best_variant(cache, mode).where(F.col("extractor_version") == version).select("source_hash")
    return documents.join(stored, "source_hash", "left_anti")


def one_path_each(documents: DataFrame, wanted: Callable[[DataFrame], DataFrame] = lambda contents: contents) -> DataFrame:
    """One row per content, that with the least path: since the suffix of a path decides how a
    content is read, the choice must not depend on the order of rows.

    Paths are compared, and ``wanted`` takes its part of them, on narrow rows (source_hash, path), which are written
    first: a content moves only if it is wanted, and where few are, not even those.
    """
    least = wanted(documents.groupBy("source_hash").agg(F.min("path").alias("path")))
    least = materialize(least.select("source_hash", F.col("path").alias("_path")), "contents-wanted")
    chosen = documents.join(least, "source_hash").where(F.col("path").eqNullSafe(F.col("_path")))
    return chosen.drop("_path").dropDuplicates(["source_hash"])


class ExtractionCache:
    """Stored extractions below a folder.

    Every append is a folder of its own, ``extractor_version=V/variant=X/batch=B``, cut by the first digit of the
    hash, and counts only once its row is among the ``commits``.  A batch is named by the contents it holds.
    An append that failed half-way left no commit, so its repetition finds the same contents
    missing, has the same name, and replaces what was written.
    """

    SCHEMA = "source_hash string, blocks array<struct<level:int,text:string,page:int>>, reject_reason string"
    PLACE = "extractor_version string, variant string, batch string, prefix string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:  # nothing is stored yet
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def stored(self) -> DataFrame:
        """All committed rows, with extractor_version and variant."""
        done = [r.batch for r in self._read(f"{self.path}/commits", "batch string, rows bigint").select("batch").distinct().collect()]
        rows = self._read(f"{self.path}/data", f"{self.SCHEMA}, {self.PLACE}")
        return rows.where(F.col("batch").isin(done)).drop("batch", "prefix")

    def append(self, extracted: DataFrame, version: str, variant: str) -> int:
        """Store (source_hash, blocks, reject_reason) and commit; the number of rows."""
        rows = materialize(extracted.select("source_hash", "blocks", "reject_reason"), "extracted")
        n, digest = rows.agg(F.count("*"), F.bit_xor(F.xxhash64("source_hash"))).first()
        if n:
            batch = f"{n:x}-{digest & (1 << 64) - 1:016x}-{variant}-{version}"
            placed = rows.withColumn("prefix", F.substring("source_hash", 1, 1)).repartition("prefix")
            target = f"{self.path}/data/extractor_version={version}/variant={variant}/batch={batch}"
            placed.write.mode("overwrite").partitionBy("prefix").parquet(target)
            self.spark.createDataFrame([(n,)], "rows bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")
        return n


def extract_cached(
    documents: DataFrame,
    cache_path: str,
    version: str,
    extract: Callable[[DataFrame], DataFrame],
    remote: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Extract what the cache at ``cache_path`` lacks, store it, and return the
    stored extraction of every document.

    ``documents`` is (source_hash, path, content); ``extract`` adds ``blocks``
    and ``reject_reason``.  ``remote`` does the same elsewhere and may say
    'unavailable': those documents fall back to ``extract`` and are stored as
    'fallback', so a later run asks the remote again.  Other reasons are final.
    """
    cache = ExtractionCache(documents.sparkSession, cache_path)

    def lacking(mode: str) -> DataFrame:
        return one_path_each(documents, lambda contents: missing(contents, cache.stored(), version, mode))

    def usable(mode: str) -> DataFrame:
        return best_variant(cache.stored(), mode).where(F.col("extractor_version") == version)

    if remote is None:
        cache.append(extract(lacking("local")), version, "local")
        return usable("local")
    tried = materialize(remote(lacking("remote")), "tried")
    cache.append(tried.where("NOT (reject_reason <=> 'unavailable')"), version, "remote")
    cache.append(extract(lacking("remote_failed")), version, "fallback")
    return usable("remote_failed")
