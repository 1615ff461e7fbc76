"""Session factory and the helpers every operator shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quaymark", cores: int | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; shuffle partitions follow the cores."""
    n = cores or os.cpu_count() or 4
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.appName(app).master(f"local[{n}]")
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a local one only where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "quaymark-shared")
        os.makedirs(found, exist_ok=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Files:
    """A few file operations on whatever file system a path names."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm = spark._jvm
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> bool:
        """The file appears whole or not at all; False if it is there already."""
        draft = f"{path}.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(draft), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not self._fs.exists(self._path(path)) and self._fs.rename(self._path(draft), self._path(path)):
            return True
        self.delete(draft)
        return False

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def make_until_end(self, folder: str) -> None:
        """A folder that goes, with all that is in it, when the driver's JVM ends. It must be there to be marked."""
        self._fs.mkdirs(self._path(folder))
        if not self._fs.deleteOnExit(self._path(folder)):
            raise OSError(f"{folder} can't be marked for deletion")


def scratch(spark: SparkSession, label: str) -> str:
    """An empty folder in the shared one for what this driver writes; it goes when the driver ends, on any file system."""
    folder = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    Files(spark, folder).make_until_end(folder)
    return folder


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage and survives a lost executor."""
    path = f"{scratch(df.sparkSession, label)}/rows"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
