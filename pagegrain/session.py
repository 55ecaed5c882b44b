"""Session factory, and how the package itself reaches the executors."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "pagegrain", **conf: str) -> SparkSession:
    """A session with this engine's defaults; ``conf`` has Spark settings with ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable on executors that do not already see this folder.

    Workers of a process started here, or with this folder on PYTHONPATH, import it as they are;
    otherwise a zip of the package is added to the session, once.
    """
    path = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) in path or os.path.realpath(os.getcwd()) == str(ROOT) or getattr(spark.sparkContext, "_pagegrain_shipped", False):
        return spark
    name = os.path.join(tempfile.mkdtemp(), "pagegrain.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((ROOT / "pagegrain").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(name)
    sys.path[:] = [p for p in sys.path if p != name]
    spark.sparkContext._pagegrain_shipped = True
    return spark


def cut_lineage(df):
    """``df`` checkpointed in the folder of spark.checkpoint.dir (a temporary one only if that is unset)."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="pagegrain-"))
    return df.checkpoint()
