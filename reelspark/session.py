"""Session construction and the few session-level settings operators rely on."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

# Settings that every job here assumes. AQE re-plans joins and coalesces
# partitions at runtime; skew-join splits oversized shuffle partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", app: str = "reelspark",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Local or cluster session with the defaults above.

    On a cluster pass ``master=None`` to keep whatever spark-submit set.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Reliable checkpoint folder of this session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; it is read
    from the session and used as is. Only when nothing is set (local tests)
    a fresh scratch folder is created; any other master without the setting
    is an error, since executors would not see each other's folders.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="reelspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate results that the caller has written below the checkpoint folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Largest Arrow batch handed to a Python worker; a worker holds a few times as much.
ARROW_BATCH_BYTES = 8 << 20


def bound_arrow_batches(spark: SparkSession, most: int = ARROW_BATCH_BYTES) -> None:
    """Lower the session's limit on the bytes of an Arrow batch to ``most`` if it
    is higher: rows of packed blocks are large, so that a number of rows alone
    bounds nothing."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)b?", spark.conf.get(key).lower()).groups()
    if not 0 < int(number) << 10 * " kmgtp".index(unit or " ") <= most:
        spark.conf.set(key, str(most))


@contextmanager
def shuffle_files_removed(spark: SparkSession):
    """Within it, an action removes the shuffle files it has made once it is done
    (for loops that checkpoint after every step)."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Functions given to mapInArrow and the like are pickled by reference, so the
    Python workers must be able to import the package wherever they run.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="reelspark-ship-")  # served from here until the application ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
