"""Written tables in the folder that all executors share.

Lineage is cut by writing a table to the folder named in ``spark.checkpoint.dir`` and
reading it back, so a lost executor costs a re-read and never a recomputation of all that
went before.  Only where the setting is absent and the master is local (tests) a temporary folder
is made.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or one of our own where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="metawatch-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return "file://" + _OWN[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back (zstd Parquet)."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where df has a column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Lower the session's limit on the bytes of an Arrow batch, where it is higher.

    Results do not depend on it.  Lists of words or ids take several times the room of their text, in the
    JVM's direct memory and in every Python worker, so the usual 64 MB a batch overfill a small executor.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    digits = now.lower().rstrip("b")
    if not digits.isdigit() or int(digits) > most:
        spark.conf.set(name, str(most))
