"""Session defaults used by tests, the benchmark and interactive work.

A cluster brings its own session; nothing in the library depends on these settings.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "tessellum", memory: str = "8g", shared: str | None = None) -> SparkSession:
    """A session on ``master``; ``shared`` is the folder of lineage-cutting tables, by default one of this machine."""
    shared = shared or os.environ.get("TESSELLUM_SHARED_DIR") or "file://" + os.path.join(tempfile.gettempdir(), "tessellum-shared")
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", shared)
        .getOrCreate()
    )
