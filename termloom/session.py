"""Session construction and the one way this library cuts lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: list[str] = []


def local_session(cpus: int | str = 8, app: str = "termloom", **extra: str) -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own."""
    conf = {
        "spark.sql.shuffle.partitions": str(cpus if str(cpus).isdigit() else 8),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | extra
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in conf.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut lineage: ``spark.checkpoint.dir`` of the session.

    Only a local master without that setting gets a temporary folder of this
    machine; a cluster that names none is refused, since executors on other
    machines could not read such a folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_DIRS:
        _OWN_DIRS.append(tempfile.mkdtemp(prefix="termloom-"))
        atexit.register(shutil.rmtree, _OWN_DIRS[0], ignore_errors=True)
    return "file://" + _OWN_DIRS[0]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the process ends."""
    path = f"{shared_dir(spark)}/termloom/{name}-{uuid.uuid4().hex}"
    parent = os.path.dirname(path.removeprefix("file://"))
    if path.startswith("file:") or os.path.isdir(os.path.dirname(parent)):
        os.makedirs(parent, exist_ok=True)
    atexit.register(_drop, path)
    return path


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Unlike ``checkpoint()`` this computes the plan a single time and keeps
    columns, so later reads prune them; losing an executor loses nothing.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(path: str) -> None:
    """Remove a written step when the process ends, where it is a plain folder or file."""
    at = path.removeprefix("file://")
    for x in (at, at + ".npy", at + ".json"):
        if os.path.isdir(x):
            shutil.rmtree(x, ignore_errors=True)
        elif os.path.exists(x):
            os.remove(x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this library to the executors, unless their Python finds it anyway."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    found = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if root in map(os.path.abspath, filter(None, found)) or app in _SHIPPED:
        return
    _SHIPPED.add(app)
    at = tempfile.mkdtemp(prefix="termloom-ship-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{at}/termloom", "zip", root, "termloom"))


#: Bytes of values up to which a written table may be broadcast.
BROADCAST_BYTES = 16 << 20


def small_side(written: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A written table for the right side of a join: broadcast if its values take at most ``limit`` bytes, else left to the planner."""
    wide = {"string", "binary"}
    cells = [F.coalesce(F.octet_length(c) if t in wide else F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c, t in written.dtypes]
    size = written.agg(F.sum(sum(cells, F.lit(0)))).first()[0] or 0
    return F.broadcast(written) if size <= limit else written
