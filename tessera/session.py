"""What a session needs: the package on the executors, and a folder for checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SENT: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Makes the package importable by the Python workers of this application; once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SENT:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(target))
        _SENT.add(sc.applicationId)
    return spark


def with_checkpoints(df: DataFrame) -> DataFrame:
    """df, after a checkpoint folder is sure to be set.

    It is the one that the cluster names in spark.checkpoint.dir. A local master has a temporary one where none is named,
    which goes with the process; on a cluster that is an error, as executors would not share it.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if sc.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
            folder = tempfile.mkdtemp(prefix="tessera-checkpoints-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return df


#: Bytes up to which a side of a join is broadcast.
SMALL = 32 << 20


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a hint to broadcast it if its rows, of about so many bytes each, are few; else as it is, for Spark to shuffle.

    Counts the rows, so df should be cheap to read twice.
    """
    return F.broadcast(df) if df.count() * row_bytes <= SMALL else df
