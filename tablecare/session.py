"""Settings the library relies on, and the shared scratch folder.

Queries may run in a session somebody else created, so the required settings
are applied at run time with ``configure`` rather than at session creation.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

REQUIRED_SETTINGS = {
    # datetimes without a zone are read as UTC
    "spark.sql.session.timeZone": "UTC",
    # column names match exactly: `Name` and `name` are two columns
    "spark.sql.caseSensitive": "true",
    # HotSpot never compiles a method beyond 8000 bytes of byte code, and a long
    # recipe fused to one method passes that soon. Above this limit Spark runs
    # the stage operator by operator, in small compiled methods: measured twice
    # as fast on recipes with several date columns.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # rows go to Python in batches that are bounded by their bytes too: 10,000 whole
    # texts would be held several times over, by the JVM and by each of its workers
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings; call before building any expression."""
    for key, value in REQUIRED_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def configured(operator: Callable[..., Any]) -> Callable[..., Any]:
    """Decorator: ``configure`` the session of the table an operator is given."""

    @functools.wraps(operator)
    def run(df: DataFrame, *args: Any, **kwargs: Any) -> Any:
        configure(df.sparkSession)
        return operator(df, *args, **kwargs)

    return run


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared ``spark.checkpoint.dir``.

    Only a local-mode session without that setting falls back to a temporary
    folder of this machine; on a cluster a local folder would not be visible to
    the executors, so the setting is demanded there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="tablecare-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
