"""The shared folder for intermediate tables and stream checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"

#: Folders of local sessions without the setting, by application.
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names; a session in one process may go without."""
    named = spark.conf.get(SETTING, None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise RuntimeError(f"set {SETTING} to a folder that all executors reach")
    application = spark.sparkContext.applicationId
    if application not in _local:
        _local[application] = tempfile.mkdtemp(prefix="caseframe-")
    return _local[application]


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
