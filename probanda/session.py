"""Session defaults and the shared scratch location."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "probanda", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps, AQE and skew-join splitting on.

    On a cluster ``master`` comes from spark-submit; nothing here fixes a partition
    count, so AQE sizes shuffles from the data.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # recording the Python call site of every column costs more than planning
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # adaptive execution reports the whole plan text again after every stage
        "spark.sql.maxPlanStringLength": "20000",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Give the Python workers this package, once per application, so its functions can
    run in tasks on machines (or from folders) where it is not installed.  Workers that
    do not see added files get the functions themselves."""
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
    context = spark.sparkContext
    if getattr(context, "_probanda_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="probanda-ship-"), "probanda.zip")
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, source.relative_to(root.parent))
    context.addPyFile(archive)
    context._probanda_shipped = True
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for written intermediates and stream checkpoints.

    Uses the cluster's ``spark.checkpoint.dir``.  Only a local session without that
    setting falls back to a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="probanda-")
        spark.conf.set("spark.checkpoint.dir", root)
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")


#: Parquet row groups of 16 MB, looked at from the first row on (Parquet's default looks at
#: none before the hundredth), so that neither a writer nor a reader holds many large rows.
SMALL_GROUPS = {
    "parquet.block.size": str(16 << 20),
    "parquet.page.size.row.check.min": "1",
}


def stored(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """Write once to the folder all executors share, and read back: cuts the lineage, so
    that lost executors cost no recomputation of what came before."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
