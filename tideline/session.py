"""Session settings and small helpers that every part shares."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def build_session(master: str = "local[*]", app: str = "tideline", **conf: str) -> SparkSession:
    """A session with the settings the engine is tested with; ``conf`` keys use ``__`` for dots."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so workers can import it
    wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    path = os.path.join(tempfile.mkdtemp(), "tideline_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(path)


def _shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``. Only a local session without one gets a
    temporary folder; on a cluster executors could not read it, so a missing setting is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):  # local-cluster runs on one machine too
            raise RuntimeError("spark.checkpoint.dir names no shared folder for intermediate tables")
        folder = _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tideline-"))
    return folder.rstrip("/")


_LOCAL: dict[str, str] = {}


def checkpointed(df):
    """Cut lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table written and read again."""
    import uuid

    return f"{_shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
