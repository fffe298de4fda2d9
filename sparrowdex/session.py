"""What a session needs: the package on its workers, and tables in the folder that all machines share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_sparrowdex_sent", False):
        return
    folder = tempfile.mkdtemp(prefix="sparrowdex")
    archive = os.path.join(folder, "sparrowdex_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, str(p.relative_to(_PACKAGE.parent)))
    sc.addPyFile(archive)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc._sparrowdex_sent = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset (tests, local mode) a folder on this machine is made and set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    made = getattr(spark.sparkContext, "_sparrowdex_dir", None)
    if made is None:
        made = tempfile.mkdtemp(prefix="sparrowdex-shared")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext._sparrowdex_dir = made
    return f"file://{made}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/sparrowdex/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back.

    A lost executor then costs a reread, never a recomputation of what led here.
    """
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._sparrowdex_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by written() that no later result reads."""
    for df in frames:
        path = getattr(df, "_sparrowdex_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
