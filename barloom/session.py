"""Session defaults used by the bench and the tests; jobs on a cluster bring their own session."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import SparkSession

import barloom

# Executors need not have the package installed: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(barloom)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session in UTC with adaptive execution on."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("barloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
