"""Replace a folder only after its successor is complete."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def locate(spark: SparkSession, path: str):
    """File system and full path, so that every task means the same place."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    file_system = jvm_path.getFileSystem(conf)
    return file_system, jvm_path.makeQualified(
        file_system.getUri(), file_system.getWorkingDirectory()
    )


def publish(
    spark: SparkSession,
    path: str,
    overwrite: bool,
    write: Callable[[str], None],
    staged: bool = False,
) -> None:
    """Let ``write`` fill the folder ``path``; if it fails, nothing has changed.

    A new folder is written in place and removed again on failure. An existing
    one is replaced only after its successor is complete: that is written beside
    it, under a name with an underscore, which readers of the parent skip.
    """
    file_system, target = locate(spark, path)
    exists = file_system.exists(target)
    if exists and not overwrite:
        raise FileExistsError(f"{path} exists; overwrite it explicitly")
    folder = target
    if exists or staged:
        unfinished = f"_{target.getName()}.unfinished-{uuid.uuid4().hex}"
        folder = target.getParent().suffix(f"/{unfinished}")
    try:
        write(folder.toString())
    except BaseException:
        file_system.delete(folder, True)
        raise
    if folder is target:
        return
    aside = None
    if exists:
        # one of the two tables is always there under some name
        aside = target.getParent().suffix(f"/_{target.getName()}.old-{uuid.uuid4().hex}")
        if not file_system.rename(target, aside):
            raise OSError(f"could not move {path} aside; the new table is {folder}")
    if not file_system.rename(folder, target):
        if aside is not None:
            file_system.rename(aside, target)
        raise OSError(f"could not move the finished table from {folder} to {path}")
    if aside is not None:
        file_system.delete(aside, True)
