"""Session helpers: building a local session for tests and resolving the
shared checkpoint folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "terrapanel") -> SparkSession:
    """A local session configured the way the tests and the bench expect.

    On a cluster, users build their own session; nothing in the library
    depends on these settings except that AQE is assumed to be on.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        # catalog tables are external (explicit paths); keep the local
        # catalog's own folder out of the working directory
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="terrapanel-warehouse-"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, registering it with the context.

    The folder comes from ``spark.checkpoint.dir``. Only a local-mode session
    without that setting (tests) gets a fresh temporary folder; on a cluster a
    missing setting is an error, because a machine-local folder would not
    survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    configured = spark.conf.get(_CHECKPOINT_KEY, None) or sc.getConf().get(_CHECKPOINT_KEY, None)
    if configured:
        if not current:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: point it at a shared folder (HDFS/S3/ABFS) "
            "so checkpoints and snapshot tables survive executor loss"
        )
    folder = tempfile.mkdtemp(prefix="terrapanel-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(folder)
    spark.conf.set(_CHECKPOINT_KEY, folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written table."""
    base = ensure_checkpoint_dir(spark)
    app = spark.sparkContext.applicationId
    return f"{base}/terrapanel/{app}/{name}-{uuid.uuid4().hex[:12]}"


def checkpoint(df, name: str = "stage"):
    """Cut lineage reliably: write ``df`` as a Parquet table in the shared
    checkpoint folder and return a DataFrame reading it.

    Used where later steps must see exactly the same rows (sampled range
    bounds are not stable under recomputation) or where a heavy plan feeds
    several outputs. Unlike ``Dataset.checkpoint`` on an unpersisted plan,
    the plan runs once; the written table is columnar and carries size
    statistics for later join planning. Never a local checkpoint: those
    die with the executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def input_bytes(df) -> int:
    """Bytes of the files that ``df`` reads."""
    spark = df.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    path = spark._jvm.org.apache.hadoop.fs.Path
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in map(path, df.inputFiles()))


#: Largest files of a side that is marked for broadcast whatever the planner's threshold.
SMALL_BYTES = 4 << 20


def broadcast_if_small(df):
    """``df`` marked for broadcast if the files that it reads are measured to
    hold at most ``SMALL_BYTES``; else the planner decides."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if input_bytes(df) <= SMALL_BYTES else df


def _table_prefix(spark: SparkSession) -> str:
    """Names of this application's staged tables begin with this."""
    return "terrapanel_" + re.sub(r"\W", "_", spark.sparkContext.applicationId) + "_"


#: Conditions by which a catalog says that it has no bucketed tables.
_NO_BUCKETS = ("UNSUPPORTED_FEATURE", "NOT_SUPPORTED_COMMAND_FOR_V2_TABLE", "NOT_SUPPORTED_COMMAND_WITHOUT_HIVE_SUPPORT")


def bucketing_unsupported(exc: AnalysisException) -> bool:
    """Whether the catalog can't hold bucketed tables (an own message of an
    external catalog has no condition). Any other error is one of the call."""
    condition = exc.getCondition()
    return condition is None or condition.split(".")[0] in _NO_BUCKETS


def max_buckets(spark: SparkSession) -> int:
    """Largest number of buckets that the session allows."""
    return int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))


#: Pieces that a table is cut into before a piece grows beyond its least bytes.
MANY_PIECES = 1024


def pieces(size: int, least: int, most: int) -> int:
    """Pieces (buckets or ranges, each a task's work) of a table of ``size``
    bytes: one for every ``least`` bytes, so that a table of some megabytes is
    spread over the cores; from ``MANY_PIECES`` on they grow to ``most`` bytes
    before there are more."""
    return max(1, -(-size // most), min(-(-size // least), MANY_PIECES))


def stage_bucketed(df, cols, n: int, name: str = "stage"):
    """Like ``checkpoint`` but the written table is bucketed on ``cols``
    (``n`` buckets) and registered in the catalog, so later windows,
    aggregations and joins keyed on ``cols`` need no exchange. Falls back
    to a plain written table when the catalog cannot hold bucketed tables.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = _table_prefix(spark) + path.rsplit("/", 1)[-1].replace("-", "_")
    try:
        df.write.format("parquet").bucketBy(n, *cols).option("path", path).saveAsTable(table)
        return spark.table(table)
    except AnalysisException as unsupported:
        if not bucketing_unsupported(unsupported):
            raise
        warnings.warn(f"bucketed staging unavailable ({unsupported.getCondition()}); writing plain Parquet")
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def drop_scratch(spark: SparkSession) -> int:
    """Remove everything this application staged: its own staged
    catalog tables and the folders under ``<checkpoint dir>/terrapanel/<app
    id>`` (stage tables, warehouse snapshots). Call it when the job is done
    with its results; DataFrames reading them become invalid. Returns the
    number of folders removed.
    """
    base = ensure_checkpoint_dir(spark)
    for t in spark.catalog.listTables():
        if t.name.startswith(_table_prefix(spark)) and not t.isTemporary:
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/terrapanel/{spark.sparkContext.applicationId}")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0
    removed = 0
    for status in fs.listStatus(root):
        fs.delete(status.getPath(), True)
        removed += 1
    return removed
