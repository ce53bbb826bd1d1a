"""Session settings and the one way this library cuts lineage.

``materialize`` writes a table into the shared folder the cluster names in
``spark.checkpoint.dir`` and reads it back.  Unlike ``checkpoint()`` it computes
the plan once and stays columnar; unlike a cached block it survives the loss of
any executor.
"""

from __future__ import annotations

import atexit
import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(app: str = "meibo", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only a local master may fall back on a folder of this machine."""
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="meibo-")
    spark.conf.set(CHECKPOINT_KEY, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        pass


#: written tables after which the driver's garbage is collected
CLEAN_EVERY = 6
_WRITTEN = itertools.count(1)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder once and return the written table (same schema).

    Spark drops the shuffle files and broadcasts of a finished step only once the driver has collected the plans that
    refer to them, which a driver with room to spare may never do: after every few tables it is asked to.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/meibo/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if next(_WRITTEN) % CLEAN_EVERY == 0:
        spark.sparkContext._jvm.System.gc()
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._meibo_path = path  # type: ignore[attr-defined]
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt over as many tasks as a shuffle has, for a step that costs more than the size of its rows tells."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def release(df: DataFrame | None) -> None:
    """Delete a table written by ``materialize`` that nothing lazy refers to any more."""
    path = getattr(df, "_meibo_path", None)
    if path:
        _remove(df.sparkSession, path)
