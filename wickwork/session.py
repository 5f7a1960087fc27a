"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import os
import pathlib
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "wickwork", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators count on: UTC, and AQE for run-time re-planning."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Candle timestamps are UTC wall clock, so the session must read and print them as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written tables and checkpoints.

    A cluster names it in ``spark.checkpoint.dir``. Only a session without that setting (tests,
    a laptop) gets a folder of its own, which is then kept for the rest of the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="wickwork-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder which no other run uses."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for tasks that run its Python code (the data sources).
    Call it before a source is registered. Not needed where the package is installed."""
    package = pathlib.Path(__file__).parent
    context = spark.sparkContext
    paths = [path for path in context.environment.get("PYTHONPATH", "").split(os.pathsep) if path]
    if str(package.parent) in paths:
        return
    # A stream plans its batches in a Python process of the driver, which only looks at the path.
    context.environment["PYTHONPATH"] = os.pathsep.join([str(package.parent), *paths])
    base = pathlib.Path(tempfile.mkdtemp(prefix="wickwork-zip-")) / "wickwork"
    context.addPyFile(shutil.make_archive(str(base), "zip", package.parent, package.name))
