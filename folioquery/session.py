"""Session helpers: a local session for tests, table access, and lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "folioquery", memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench share."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors once per application, so that their Python workers need no path of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_folioquery_shipped", False):
        return
    here = Path(__file__).resolve().parent
    if here.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="folioquery-code-")) / f"{here.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(here.rglob("*.py")):
                z.write(f, f.relative_to(here.parent))
        sc.addPyFile(str(archive))
    sc._folioquery_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables and checkpoints: the one the cluster names in spark.checkpoint.dir.

    A temporary folder of this machine is taken only where the setting is missing and the master is local, as in tests; on a cluster executors
    could not write where the driver reads, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="folioquery-ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of df by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def shuffle_width(spark: SparkSession) -> int:
    """The number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def store_path(df: DataFrame) -> str:
    """Write df once as parquet into the shared folder; the path."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def store(df: DataFrame) -> DataFrame:
    """Write df once as parquet into the shared folder and read it back: a lineage cut that keeps column pruning."""
    return df.sparkSession.read.schema(df.schema).parquet(store_path(df))


def table_state(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(bytes, files, last change) of a table's files, from the file system's listing alone."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files, size, number, changed = fs.listFiles(where, True), 0, 0, 0
    while files.hasNext():
        f = files.next()
        size, number, changed = size + f.getLen(), number + 1, max(changed, f.getModificationTime())
    return size, number, changed


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
