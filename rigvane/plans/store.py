"""Tables that several parts of a plan read, written once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the folder of spark.checkpoint.dir; what reads them does not compute them again, nor when an executor is lost.

    Where the setting is unset, only a local master gets a folder of its own."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them can read")
            folder = tempfile.mkdtemp(prefix="rigvane-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
