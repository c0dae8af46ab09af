"""Sends this package to the Python workers, as ``spark-submit --py-files`` would."""

from __future__ import annotations

import os
import shutil
import tempfile
from threading import Lock

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))
_sent: set[str] = set()
_sending = Lock()


def ship_code(spark: SparkSession) -> None:
    """Once per application; Spark's own file server hands the archive to every executor.

    Threads wait for each other: the file server refuses a second archive of the same name.
    """
    context = spark.sparkContext
    with _sending:
        if context.applicationId in _sent:
            return
        folder, name = os.path.split(PACKAGE)
        stem = os.path.join(tempfile.mkdtemp(prefix="package-"), name)
        context.addPyFile(shutil.make_archive(stem, "zip", folder, name))
        _sent.add(context.applicationId)
