"""Session construction and the shared scratch area used to cut lineage."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "kgspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and skew handling on; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.unionOutputPartitioning": "false",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    base.update({k.replace("__", "."): v for k, v in conf.items()})
    for k, v in base.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is made on one machine (tests); on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="kgspark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    The archive is put into the shared folder and registered with the application, so the workers
    need neither this repository on their machines nor the driver's import path.
    """
    sc = spark.sparkContext
    # Under Spark 4.1 an aggregate on a union of two equally partitioned branches can return a group
    # twice; see operators/oplog.py.
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    if _shipped.get("app") == sc.applicationId:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    path = f"{shared_dir(spark)}/kgspark-{uuid.uuid4().hex}.zip"
    jvm = sc._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(sc._jsc.hadoopConfiguration()).create(p)
    out.write(data.getvalue())
    out.close()
    sc.addPyFile(path)
    own(spark, path)
    _shipped["app"] = sc.applicationId


_shipped: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame, *partition_cols: str) -> DataFrame:
    """Write ``df`` once as a compressed table in the shared folder and read it back.

    Later jobs start from the written files, so losing an executor never repeats the work
    before the cut. The table is removed when the session's program ends, or by ``forget``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kgspark-{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_cols) if partition_cols else w).parquet(path)
    own(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kgspark_path = path
    return out


def own(spark: SparkSession, path: str) -> None:
    """Have ``path`` in the shared folder removed at the end of the program, or by ``sweep``."""
    if not _written:
        atexit.register(sweep)
    _written.append((spark, path))


def forget(df: DataFrame) -> None:
    """Remove the table behind a frame returned by ``cut`` once nothing reads it any more."""
    path = getattr(df, "_kgspark_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [(s, p) for s, p in _written if p != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def sweep() -> None:
    """Remove everything this program still keeps in the shared folder, once its results are written."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # the JVM may already be gone; the folder's own retention applies then
            return
