"""Session settings shared by tests, bench and jobs."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: A key with more rows than this is split by day instead of being windowed in one task.
HOT_KEY_ROWS = "antecede.hotKeyRows"
HOT_KEY_ROWS_DEFAULT = 5_000_000

#: A window task is given about this many rows at most, whatever the size of the table.
WINDOW_ROWS = "antecede.windowRows"
WINDOW_ROWS_DEFAULT = 200_000

#: A dimension with at most this many rows may be broadcast.
BROADCAST_ROWS = "antecede.broadcastRows"
BROADCAST_ROWS_DEFAULT = 2_000_000

#: And with at most this many bytes as it is cached; the driver and every executor hold it some times over.
BROADCAST_BYTES = "antecede.broadcastBytes"
BROADCAST_BYTES_DEFAULT = 16_000_000


def local_session(cores: int | str = 8, app: str = "antecede") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        # joins on (match, player) and on (match, player, prop) may share one exchange
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def setting(spark: SparkSession, name: str, default: int) -> int:
    return int(spark.conf.get(name, str(default)))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind when it is written; otherwise they stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; only an unset one (tests) gets a local folder."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="antecede-checkpoint-")
    spark.sparkContext.setCheckpointDir(shared)
