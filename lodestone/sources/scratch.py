"""Folders for what a job needs on the way, where all executors see them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

from ..errors import StorageError


def scratch_path(spark: SparkSession) -> str:
    """A new name in the folder of spark.checkpoint.dir; where that is unset and all of Spark is one process, in a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise StorageError("Set spark.checkpoint.dir to a folder that the driver and all executors see")
        shared = tempfile.mkdtemp(prefix="lodestone-")
    return f"{shared}/{uuid.uuid4().hex}"
