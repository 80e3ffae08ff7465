"""Session helpers: the time zone, the shared checkpoint folder, table loading."""

from __future__ import annotations

import atexit
import hashlib
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


#: The folder that holds this package.
ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Months and dates are those of UTC in every session, and Python workers find this package wherever they start."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read lazily."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  Where the session names none, a local master gets a temporary one; a cluster is refused."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not named:
        if not re.fullmatch(r"local(?:\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set(CHECKPOINT_KEY, named)
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    return named


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; deleted at its end."""
    application = spark.sparkContext.applicationId
    if application not in _registered:
        _registered.add(application)
        atexit.register(_release_quietly, spark)
    return f"{shared_dir(spark).rstrip('/')}/lexmill/{application}"


def release(spark: SparkSession) -> None:
    """Delete the tables this application has written to the shared folder; frames that read them can be read no more.

    Called at the end of the Python process by itself."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def _release_quietly(spark: SparkSession) -> None:
    try:
        release(spark)
    except Exception:  # noqa: BLE001  the session has ended before the process
        pass


_registered: set[str] = set()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def once(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table called ``name`` of this application: built in the shared folder by the first that asks, read by all later ones."""
    path = f"{own_dir(spark)}/once-{hashlib.sha1(name.encode()).hexdigest()[:16]}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The result has no lineage, so a lost executor costs a re-read and not a
    recomputation, and a non-deterministic stage is evaluated once.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
