"""Session helpers: building a session, and cutting lineage with shared storage."""

from __future__ import annotations

import itertools
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the command line; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one of our own only where that is unset, in local mode."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="landreach-"))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once a session, so they need no copy of their own."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).parent
    packed = Path(tempfile.mkdtemp(prefix="landreach-")) / "landreach.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(packed))


#: Buckets of a stored table; more values than this share buckets.
MOST_BUCKETS = 10_000


class Scratch:
    """Tables written to the shared folder in the course of one computation.

    ``save`` cuts the lineage of an iterative plan: the rows are written as
    Parquet and read back, so a lost executor costs no more than the tasks it
    ran. ``drop`` deletes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._numbers = itertools.count(1)  # steps may run side by side

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{next(self._numbers)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def bucket(self, df: DataFrame, column: str, most: int) -> DataFrame:
        """The rows stored in buckets by a column of at most ``most`` values, so that grouping by it shuffles nothing."""
        name, n = f"landreach_{uuid.uuid4().hex}", max(1, min(most, MOST_BUCKETS))
        df.repartition(n, column).write.bucketBy(n, column).sortBy(column).format("parquet").option("path", f"{self.root}/{next(self._numbers)}").saveAsTable(name)
        return self.spark.table(name)

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)  # type: ignore[attr-defined]
            path.getFileSystem(conf).delete(path, True)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
