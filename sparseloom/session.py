"""Session settings used by tests, the benchmark and the command line."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "sparseloom", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC time.

    Under spark-submit master and memory come from there; elsewhere a local session is made.
    """
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    }
    if master or "PYSPARK_GATEWAY_PORT" not in os.environ:
        builder = builder.master(master or "local[*]")
        settings |= {"spark.driver.memory": "8g", "spark.ui.enabled": "false"}
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    return builder.config(map=settings | conf).getOrCreate()
