"""Session helpers: a local session for tests and benches, and shared-folder checkpoints."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

HOT_KEY_ROWS_CONF = "turfspark.hotKeyRows"
DEFAULT_HOT_KEY_ROWS = 4_000_000


def local_session(cores: int | str = "*", *, shuffle_partitions: int = 8, app: str = "turfspark"):
    """A local session for tests and benches. A cluster job brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # the JVM doesn't compile longer methods; Spark then splits them instead of fusing the stage
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate()
    )


def hot_key_rows(spark: SparkSession) -> int:
    """Rows of one key that a single task may sort; keys above it are split."""
    return int(spark.conf.get(HOT_KEY_ROWS_CONF, str(DEFAULT_HOT_KEY_ROWS)))


def shared_folder(spark: SparkSession) -> str:
    """A new folder for intermediate data, inside the one `spark.checkpoint.dir` names.

    Only a local session may fall back to a temporary folder: on a cluster the
    files of a machine-local folder are lost with their executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/run-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may be gone already; the folder is scratch
        return


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with Parquet files in the shared folder, removed when the driver ends.

    For wide frames of which each reader wants a few columns or years; a checkpoint holds and reads whole rows.
    """
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    atexit.register(_remove, spark, folder)
    path = folder if "://" in folder else f"file://{folder}"
    df.write.option("compression", "zstd").parquet(f"{path}/table")
    return spark.read.schema(df.schema).parquet(f"{path}/table")


@contextlib.contextmanager
def feed_charsets(spark: SparkSession) -> Iterator[None]:
    """Allow the feed's code page in `encode`/`decode`, replacing unmappable characters.

    The settings are read while a column is resolved, so they are only needed
    while a plan is being built, not while it runs.
    """
    keys = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")
    before = {key: spark.conf.get(key, None) for key in keys}
    for key in keys:
        spark.conf.set(key, "true")
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
