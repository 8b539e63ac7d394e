"""Session settings shared by the jobs, the benchmark and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", app: str = "fieldpulse") -> SparkSession:
    """A single-machine session for tests and benchmarks.

    On a cluster the session comes from the submitter; nothing in the library
    depends on the values set here except the UTC time zone.
    """
    partitions = "8" if cpus == "*" else str(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Checkpoint folder for iterative models: the shared one in ``spark.checkpoint.dir``.

    A local session without that setting goes without checkpoints.
    """
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir", None)
    if shared:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(shared)
        return shared
    current = context.getCheckpointDir()
    if not current and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return current
