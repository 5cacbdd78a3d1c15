"""Session defaults and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_MOUNTED: dict[tuple[str, str], bool] = {}


def build_session(app: str = "pairlab", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on; sizes are left to the cluster's own settings."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (joins are over-estimated, so it errs to 'large')."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except Exception:  # no JVM handle: treat the plan as large
        return 1 << 62


def _scheme(spark: SparkSession, path: str) -> str:
    """The store of a path: its own scheme, or that of the default file system."""
    if ":" not in path.split("/", 1)[0]:
        path = spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return path.split(":", 1)[0]


def _mounted_everywhere(spark: SparkSession, root: str) -> bool:
    """Whether rows that tasks write under a local path are all there for the driver, as on a mounted share.

    The answer is kept per application and path.
    """
    key = (spark.sparkContext.applicationId, root)
    if key not in _MOUNTED:
        try:
            path, n = f"{root.rstrip('/')}/pairlab/{key[0]}/probe-{uuid.uuid4().hex}", 64
            spark.range(0, n, 1, n).write.parquet(path)
            _MOUNTED[key] = spark.read.schema("id long").parquet(path).count() == n
        except Exception:  # what cannot be tried is not taken for shared
            _MOUNTED[key] = False
    return _MOUNTED[key]


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the session, else its warehouse; a folder of the driver only if it runs the tasks too.

    The session names it by spark.checkpoint.dir or by setCheckpointDir.  On a
    cluster a path of the local file system counts if the executors have it
    mounted too; executors of a local cluster have temp folders of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.master.startswith("local"):
        if root:
            return root.rstrip("/")
        if not context.master.startswith("local-cluster"):
            if context.applicationId not in _LOCAL_ROOTS:
                _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="pairlab-")
            return _LOCAL_ROOTS[context.applicationId]
    set_on_context = getattr(context, "getCheckpointDir", lambda: None)()
    named = root or set_on_context or spark.conf.get("spark.sql.warehouse.dir", None)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if _scheme(spark, named) == "file" and not _mounted_everywhere(spark, named):
        raise ValueError(f"{named} is on one machine only; spark.checkpoint.dir must be a folder every executor can reach")
    return named.rstrip("/")


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_parquet(df: DataFrame, path: str) -> None:
    """Write a table; the shuffle files of this write alone are removed once it is done."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(SHUFFLE_CLEANUP)
        else:
            conf.set(SHUFFLE_CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Store an intermediate table in the shared folder and return the stored copy.

    Cuts the lineage with files that outlive any executor, so later branches
    read them instead of repeating the plan.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    write_parquet(df, path)
    return spark.read.schema(df.schema).parquet(path)


def run_folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{scratch_root(spark)}/pairlab/{spark.sparkContext.applicationId}"


def drop_intermediates(spark: SparkSession) -> None:
    """Delete what this application stored; call it once its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
