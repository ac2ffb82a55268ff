"""What the library needs of a session: the package on its workers, and a shared folder for what loops write."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_told: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Give the workers of a session this package, once, wherever it was started."""
    context = spark.sparkContext
    if context.applicationId in _told:
        return
    _told.add(context.applicationId)
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="vocabra-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder, "vocabra.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.glob("**/*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(str(path))


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which spark.checkpoint.dir names. Only where all of Spark is one process, as in tests, a folder of
    this machine stands in for one that is not named."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="vocabra-checkpoints-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
