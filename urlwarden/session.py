"""Session settings the jobs rely on, and the shared folder for intermediate tables."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only, so they also work on a session somebody else built.
# Skewed join sides are split by the adaptive planner even where that costs one more shuffle.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM compiles no method above this size: such stages run as functions it does compile.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Long texts and vectors go to Python workers in batches of bounded size.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def tune(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: int | str = 8, app: str = "urlwarden") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


_LOCAL_ROOT: dict[str, str] = {}
_SCRATCH: list[list[str]] = []


def delete_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are deleted at the end; write or collect results before."""
    made: list[str] = []
    _SCRATCH.append(made)
    try:
        yield
    finally:
        _SCRATCH.remove(made)
        for path in made:
            delete_folder(spark, path)


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors reach; on a local master without one, a fresh folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_ROOT:
            _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="urlwarden-", dir="/tmp")
        root = _LOCAL_ROOT[app]
    return root.rstrip("/")


_SHARED: dict[tuple[str, str], str] = {}


def shared(spark: SparkSession, name: str, build: Callable[[str], None]) -> str:
    """The folder of a table that jobs of one application share: built by the first that asks for it."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _SHARED:
        path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        build(path)
        _SHARED[key] = path
    return _SHARED[key]


def fingerprint_of(spark: SparkSession, path: str) -> str:
    """Sizes and times of the files of a table, so that a table written anew is told from the old one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    told = sorted(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}" for f in found)
    return hashlib.sha256("\n".join([path, *told]).encode()).hexdigest()[:16]


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder for one job's tables, below the shared folder of the cluster."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


def materialise(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = workspace(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write the rows as they lie in their partitions: partitions and their order stay what they are."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()
