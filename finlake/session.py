"""Spark session defaults for finlake jobs.

On a cluster the session is created by the platform; ``configure`` only fills in settings that
are unset, so cluster-provided values (shuffle partitions, checkpoint dir, ...) always win.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

# Settings every finlake job relies on for determinism and adaptive planning.
_REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply finlake's session settings where the cluster has not set them."""
    conf = spark.conf
    for key, value in _REQUIRED.items():
        if conf.get(key, None) in (None, ""):
            conf.set(key, value)
    conf.set("spark.sql.session.timeZone", "UTC")
    _share_package_path(spark)
    return spark


def _share_package_path(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it. On a cluster the package
    is installed or passed with ``--py-files``; a path that does not exist there is ignored."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when it is unset and the master is local (tests) a private scratch folder is created and
    registered; on a cluster executors would not see each other's files there, so that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if named:
        sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir is not set; on a cluster it must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="finlake-ckpt-", dir=os.environ.get("FINLAKE_SCRATCH", "/tmp"))
    spark.sparkContext.setCheckpointDir(path)
    try:
        spark.conf.set("spark.checkpoint.dir", path)
    except Exception:  # noqa: BLE001 - the key may be static in some deployments; the context dir is set
        pass
    return path


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "finlake") -> SparkSession:
    """Session for tests and the local benchmark (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FINLAKE_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def at_once(spark: SparkSession, steps: Sequence[Callable], threads: int = 4) -> list:
    """What the steps return, each of which starts jobs of its own: side by side, so that the cores are not idle while one
    step is planned or its last tasks run. All have ended when the error of one is raised."""
    if len(steps) < 2:
        return [step() for step in steps]
    with ThreadPoolExecutor(threads) as pool:
        done = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
    return [d.result() for d in done]


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go when the query ends, not when the driver next collects its
    garbage: the jobs of a step need no room for the files of those before."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
