"""A vector store on tables: records (id, values, metadata, namespace) in Parquet snapshots, searched by exact cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cosine

SCHEMA = "id string, values array<float>, metadata map<string,string>, namespace string"


def matches(metadata: Column, wanted: dict[str, str] | None) -> Column:
    """Whether every wanted key has its value; nothing wanted matches all."""
    out = F.lit(True)
    for k, v in (wanted or {}).items():
        out = out & F.coalesce(F.try_element_at(metadata, F.lit(k)) == v, F.lit(False))
    return out


class VectorStore:
    """Snapshots under a folder of any file system; each write makes the next one and then points to it.

    A reader keeps the snapshot it opened, and a write that dies leaves the pointer where it was, so a lost executor or
    driver never leaves a half-written table behind.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(path)]
        return sorted(int(n[1:]) for n, p in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(hadoop.Path(p, "_SUCCESS")))

    def all(self) -> DataFrame:
        """Every record of the last whole snapshot."""
        v = self._versions()
        return self.spark.read.parquet(f"{self.folder}/v{v[-1]}") if v else self.spark.createDataFrame([], SCHEMA)

    def _write(self, df: DataFrame) -> None:
        df.select("id", "values", "metadata", "namespace").write.mode("overwrite").parquet(f"{self.folder}/v{(self._versions() or [-1])[-1] + 1}")

    def upsert(self, records: DataFrame) -> None:
        """Takes records in; one of the same namespace and id is replaced. All values must have one length, the store's own."""
        lengths = {r.n for r in records.select(F.size("values").alias("n")).distinct().limit(2).collect()}
        stored = self.all().select(F.size("values").alias("n")).first()
        if len(lengths) > 1 or (stored and lengths and stored.n not in lengths):
            raise ValueError(f"values of different lengths: {sorted(lengths | ({stored.n} if stored else set()))}")
        new = records.withColumn("namespace", F.coalesce("namespace", F.lit("")))
        self._write(self.all().join(new.select("namespace", "id"), ["namespace", "id"], "left_anti").unionByName(new.select("id", "values", "metadata", "namespace")))

    def delete(self, ids: list[str], namespace: str = "") -> None:
        self._write(self.all().where(~(F.col("id").isin(*ids) & (F.col("namespace") == namespace))))

    def clear(self, namespace: str | None = None) -> None:
        """Drops a namespace, or everything."""
        self._write(self.all().where(F.lit(False) if namespace is None else F.col("namespace") != namespace))

    def fetch(self, ids: list[str], namespace: str = "") -> DataFrame:
        return self.all().where(F.col("id").isin(*ids) & (F.col("namespace") == namespace))

    def query(self, vector: list[float], k: int = 10, wanted: dict[str, str] | None = None, namespace: str = "", least: float | None = None) -> DataFrame:
        """(id, score, metadata) of the k nearest by cosine, filtered before they are scored, ties by id."""
        rows = self.all().where((F.col("namespace") == namespace) & matches(F.col("metadata"), wanted))
        stored = rows.select(F.size("values").alias("n")).first()
        if stored and stored.n != len(vector):
            raise ValueError(f"a query of {len(vector)} dimensions in a store of {stored.n}")
        x = rows.select("id", cosine(F.col("values"), F.array(*[F.lit(float(v)) for v in vector])).alias("score"), "metadata")
        x = x.where(F.col("score") >= least) if least is not None else x
        return x.orderBy(F.desc("score"), "id").limit(k)

    def stats(self) -> DataFrame:
        """(namespace, records, dimensions)."""
        return self.all().groupBy("namespace").agg(F.count("*").alias("records"), F.max(F.size("values")).alias("dimensions"))
