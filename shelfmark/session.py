"""Session defaults shared by the bench, the tests and stand-alone use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int = 8, **conf: str) -> SparkSession:
    """A session in UTC with ANSI casts and adaptive execution.

    Nothing here overrides what a cluster already sets on a running session; ``partitions`` is only the
    starting number that adaptive execution coalesces from.
    """
    builder = SparkSession.builder.appName("shelfmark")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("SHELFMARK_DRIVER_MEMORY", "8g"),
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
