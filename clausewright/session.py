"""Session helpers: recommended settings and the shared checkpoint folder.

Lineage is cut with ``checkpoint()`` only, into the folder that the cluster names in
``spark.checkpoint.dir``; every executor can read it again after another one is lost.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "clausewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, skew handling, UTC and Arrow on; ``conf`` overrides."""
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``; only a local session without one gets its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get(CHECKPOINT_KEY)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="clausewright-checkpoint-")
    context.setCheckpointDir(named)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint of ``df``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def share_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from the driver's path, wherever the driver was started.

    It holds where executors see the same folder; elsewhere the package is shipped with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *([paths] if paths else [])])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists in whatever file system it names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
