"""Session helpers: one place that builds a SparkSession for tests and
benchmarks, and one that finds the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job of the library relies on. AQE re-plans joins and
# shuffles at run time (coalescing small partitions, splitting skewed
# ones); ANSI stays on, so our own divisions use try_divide.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, partitions: int | None = None,
              app: str = "quarry", driver_memory: str = "16g") -> SparkSession:
    """Build (or reuse) a session. On a cluster, pass nothing and let
    spark-submit supply master and resources."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    if master and master.startswith("local"):
        # local mode: the driver JVM is the whole cluster; give it room
        b = b.config("spark.driver.memory", driver_memory)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return importable(spark)


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver did, when
    that is no installed place: the folder joins their PYTHONPATH. (Where
    executors do not see that folder, ship the package with --py-files.)"""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    parts = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if home not in parts:
        env["PYTHONPATH"] = os.pathsep.join([*parts, home])
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names it; we only read it. Where it is unset (tests on
    ``local[*]``), a scratch folder is made. On a non-local master an unset
    folder is an error, because a machine-local folder would not survive
    the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; name a shared folder for it")
        path = tempfile.mkdtemp(prefix="quarry-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


TASK_ROWS = 1_000_000       # most rows of a task that keeps them for an iterative fit


def spread(df, n: int, rows: int):
    """The ``n`` rows of ``df`` in even partitions, one per core if each gets ``rows``
    rows at least, and more if a partition would exceed ``TASK_ROWS``. For iterative
    fits: a table of a few files or row groups would keep as few tasks busy."""
    tasks = max(1, min(-(-n // rows), max(df.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS))))
    return df.repartition(tasks)


def cut_lineage(df, eager: bool = True):
    """Materialise ``df`` in the shared checkpoint folder and return a frame
    that reads it back, so a lost executor never recomputes a long lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)




def run_parallel(fns, max_workers: int = 4):
    """Run independent Spark jobs from a few driver threads (as
    CrossValidator's ``parallelism`` does): the scheduler interleaves their
    tasks, so small stages of one job fill cores idle in another. Results
    come back in input order."""
    fns = list(fns)
    if len(fns) <= 1 or max_workers <= 1:
        return [f() for f in fns]
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=min(max_workers, len(fns))) as ex:
        return list(ex.map(lambda f: f(), fns))
