"""Session settings the plans rely on, and the shared folder for checkpoints and scratch tables."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package (as ``--py-files`` would), once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="gridlark-code-")) / PACKAGE.name
    context.addPyFile(shutil.make_archive(str(archive), "zip", PACKAGE.parent, PACKAGE.name))
    _shipped.add(context.applicationId)


#: Rows that travel to a Python worker at once: a vector of the hash embedding has 12 KB, so 10,000 would be 120 MB, several
#: times over in each worker; a page of text has some kilobytes, and a stage of the pipeline sends it twice.
ARROW_ROWS = 1024


def prepare(spark: SparkSession) -> SparkSession:
    """Zone-less times are UTC; AQE may split hot partitions and pick joins from real sizes."""
    ship_code(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def prepare_vectors(spark: SparkSession) -> SparkSession:
    """As above, for queries that move vectors or long texts: Arrow batches stay small."""
    prepare(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


#: For Python workers: what a task frees goes back to the system at once. Else each worker keeps some 100 MB of freed arrays
#: from stage to stage, and Spark keeps a worker for every Python step that ever ran at a time. (glibc's limits, fixed here
#: as they would grow with the largest array freed; Arrow's buffers are glibc's too.)
RETURNED = {"MALLOC_MMAP_THRESHOLD_": str(2 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def returning_memory(stage: Callable) -> Callable:
    """The stage, whose Python functions run in workers with the environment above. Functions made elsewhere don't."""

    @wraps(stage)
    def made(spark: SparkSession, *args, **kwargs):
        environment = spark.sparkContext.environment
        added = {k: v for k, v in RETURNED.items() if k not in environment}
        environment.update(added)
        try:
            return stage(spark, *args, **kwargs)
        finally:
            for k in added:
                del environment[k]

    return made


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only a local session without the setting gets a temporary folder of its own.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    folder = context.getConf().get(CHECKPOINT_DIR) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="gridlark-")
    spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
