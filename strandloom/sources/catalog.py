"""Relations of snapshots as Parquet under one folder; a snapshot counts once its manifest is there.

Layout: <root>/<relation>/snapshot=<id>/..., and <root>/_manifest/snapshot=<id> last of all.
Writes are per snapshot and may be repeated; readers see whole snapshots only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import hashing
from strandloom.operators import ranking


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def save(self, snapshot: str, relations: dict[str, DataFrame], number: int) -> None:
        """Write all relations of a snapshot, its manifest last. ``number`` orders snapshots."""
        for name, df in relations.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/snapshot={snapshot}")
        rows = [(name, number) for name in sorted(relations)]
        self.spark.createDataFrame(rows, "relation string, number long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/_manifest/snapshot={snapshot}")

    def snapshots(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/_manifest").schema("relation string, number long, snapshot string").parquet(f"{self.root}/_manifest").select("snapshot", "number").distinct()

    def latest(self) -> str | None:
        got = self.snapshots().agg(F.max_by("snapshot", "number")).first() if self._exists(f"{self.root}/_manifest") else None
        return got[0] if got else None

    def load(self, relation: str, snapshot: str | None = None) -> DataFrame:
        snapshot = snapshot or self.latest()
        if snapshot is None or not self._exists(f"{self.root}/_manifest/snapshot={snapshot}"):
            raise LookupError(f"no whole snapshot {snapshot or ''}")
        return self.spark.read.parquet(f"{self.root}/{relation}/snapshot={snapshot}")

    def append_log(self, entries: DataFrame, content: list[str]) -> int:
        """Append entries whose content is new, numbered on from the last; how many there were."""
        at = f"{self.root}/log"
        hashed = entries.withColumn("content_hash", hashing.sha256(F.concat_ws(hashing.UNIT, *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in content]))).dropDuplicates(["content_hash"])
        last = 0
        if self._exists(at):
            log = self.spark.read.parquet(at)
            hashed = hashed.join(log.select("content_hash"), "content_hash", "left_anti")
            last = log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        numbered = ranking.numbered(hashed, "seq", ["content_hash"], last)
        n = numbered.count()
        numbered.write.mode("append").parquet(at)
        return n

    def log(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/log")


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_anonymized(df: DataFrame, path: str, names: dict[str, str], dropped: list[str]) -> None:
    """JSON with the named columns replaced by stable tokens and others left out."""
    out = df.drop(*dropped)
    for column, prefix in names.items():
        out = out.withColumn(column, hashing.anonymous(prefix, F.col(column)))
    out.write.mode("overwrite").json(path)


def read_inbox(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of a folder; a malformed one is a row with its text in ``_corrupt``."""
    return spark.read.schema(schema + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", "true").json(path)
