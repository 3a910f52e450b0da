"""Tables written between stages, in the folder all executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where it is unset (tests, one machine)."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="kinfold-")
        import shutil

        atexit.register(shutil.rmtree, _OWN[app], True)
    return f"file://{_OWN[app]}"


class Scratch:
    """Parquet tables that cut lineage: a lost executor costs a read, not a recomputation of everything before.

    drop() frees single tables and close() all of them; what a returned result still reads goes when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/kinfold-{uuid.uuid4().hex}"
        self.n = 0

    def _path(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, hashes: bool = False) -> DataFrame:
        """hashes: mostly numbers without repeats, of which dictionaries would only cost time."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        df.write.mode("overwrite").option("parquet.enable.dictionary", str(not hashes).lower()).parquet(path)
        if self.n == 1:
            root, fs = self._path(self.root)
            fs.deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kept_at = path  # the handle that drop() takes goes with the frame itself
        return out

    def keep_counted(self, df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
        """As keep(), and aggregates that are taken while the rows are written: no read-back, no second pass."""
        seen = Observation()
        out = self.keep(df.observe(seen, *(m.alias(name) for name, m in metrics.items())))
        return out, seen.get

    def drop(self, *frames: DataFrame) -> None:
        """Frames that keep() returned; others have no table and are passed over."""
        for df in frames:
            if path := getattr(df, "_kept_at", None):
                p, fs = self._path(path)
                fs.delete(p, True)

    def close(self) -> None:
        root, fs = self._path(self.root)
        fs.delete(root, True)

    def free(self) -> None:
        """Lets Spark's cleaner remove the shuffle files of plans that nothing refers to any more."""
        # Spark refers to what ran last, so something small runs last
        self.spark.range(1).count()
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
