"""Folders every executor can reach, for staged tables and stream state."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


@cache
def _own_folder() -> str:
    """A temporary folder of this process, for sessions without executors elsewhere."""
    folder = tempfile.mkdtemp(prefix="hooktrace-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the folder the cluster shares.

    The shared folder is the session's ``spark.checkpoint.dir``, or else the checkpoint folder
    that was set on the context. Only a master of one process may do without: it uses a temporary
    folder that goes away with the process.
    """
    context = spark.sparkContext
    root = spark.conf.get(_SETTING, None) or context.getConf().get(_SETTING) or context.getCheckpointDir()
    if not root:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError(f"set {_SETTING} to a folder all executors share")
        root = _own_folder()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def staged(rows: DataFrame, purpose: str) -> DataFrame:
    """Write rows once to the shared folder and read them back.

    Cuts the lineage: a lost executor costs a re-read, not the work upstream,
    and every later pass reads only the columns it needs.
    """
    path = shared_folder(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
