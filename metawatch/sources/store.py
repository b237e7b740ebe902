"""Tables that are written once, for what must not or should not be computed again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_OWN: dict[str, str] = {}


def once(df: DataFrame, name: str) -> DataFrame:
    """df, written to the folder in spark.checkpoint.dir and read back; where that is unset a local master takes a folder of its own."""
    spark = df.sparkSession
    folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not folder:
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="metawatch-core-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        folder = "file://" + _OWN[app]
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
