"""Session helpers shared by every operator: building a session, shipping the package, durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own_folders: dict[str, str] = {}
BATCH, BATCH_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"


def build_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("plumbline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers through Spark's own file server, once per application. Where nothing else is
    set, the session's batches for Python become smaller, as rows hold whole texts, or two of them."""
    context = spark.sparkContext
    if spark.conf.get(BATCH) == BATCH_DEFAULT:
        spark.conf.set(BATCH, BATCH_ROWS)
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="plumbline-")) / "plumbline.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, Path(root.name) / path.relative_to(root))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def durable_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` or the context's checkpoint directory. Only a local
    session, whose executors are this process, may go without and gets a folder of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_folders.get(context.applicationId)
        if folder is None:
            folder = _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="plumbline-shared-")
    return f"{folder.rstrip('/')}/{context.applicationId}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{durable_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``durable`` that nothing will read again; other DataFrames are left alone."""
    for df in tables:
        if (path := vars(df).get("durable_path")) is not None:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def file_bytes(path: str) -> bytes:
    """A vocabulary or model file, read where the driver runs; executors get its bytes."""
    return Path(path).read_bytes()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if its scan has fewer tasks than that, as with one small file; larger inputs stay as
    they are and are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
