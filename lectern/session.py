"""Session helpers: a default local session, table reading and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.shuffle.partitions": "8",
    "spark.driver.memory": "8g",
}


def local_session(cores: str | int = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; production jobs bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lectern")
    for key, value in {**LOCAL_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only where a local session names none (tests) is a temporary folder set; on a cluster, whose
    executors share no such folder, that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("name a folder all executors share in spark.checkpoint.dir")
    local = "file://" + os.path.join(tempfile.gettempdir(), f"lectern-{os.getpid()}")
    spark.sparkContext.setCheckpointDir(local)
    return local


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one operator's written tables inside the shared folder."""
    return f"{shared_dir(spark)}/lectern/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a written table: columnar and compressed, it survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_over(df: DataFrame, path: str) -> DataFrame:
    """Cut lineage with the table in ``path``, written over; nothing may still read what stood there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Commits:
    """The commits of a store in ``path``: numbered, each complete once its marker is there.

    What a commit writes before its marker is overwritten when the commit is tried again, so a
    store can be opened, resumed and retried by any session. A marker carries the caller's label
    (such as the number of a micro-batch).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = sorted(s.getPath().getName() for s in self.fs.listStatus(self.path)) if self.fs.exists(self.path) else []
        self.labels = [n.partition("-")[2] for n in names]

    def __len__(self) -> int:
        return len(self.labels)

    def mark(self, label: str = "") -> None:
        self.fs.create(self.path.suffix(f"/{len(self):06d}-{label}"), False).close()
        self.labels.append(label)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if it is proven to hold at most ``rows`` rows; else as it is, to be shuffled.

    Meant for written tables of narrow rows, whose count costs next to nothing.
    """
    return broadcast(df) if df.count() <= rows else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package where their path lacks it (once a session)."""
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = Path(tempfile.mkdtemp(prefix="lectern-code-")) / "lectern.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted((root / "lectern").rglob("*.py")):
            z.write(source, source.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
