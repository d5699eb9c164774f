"""Session and scratch-location helpers.

Library code never picks a machine-local folder on its own: intermediate and
state snapshots go under the folder the cluster names in
``spark.checkpoint.dir``.  Only :func:`local_session` (tests, bench, local
runs) sets one, and only when the session has none.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "grantweave") -> SparkSession:
    """Local session for tests and benchmarks (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the session names, or None."""
    try:
        d = spark.conf.get(_CKPT_KEY, None)
    except Exception:  # pragma: no cover - conf not readable (connect)
        d = None
    if d:
        return d
    try:
        return spark.sparkContext.getCheckpointDir()
    except Exception:  # pragma: no cover - no SparkContext (connect)
        return None


def _is_local(spark: SparkSession) -> bool:
    try:
        master = spark.sparkContext.master
    except Exception:  # pragma: no cover - no SparkContext (connect)
        master = spark.conf.get("spark.master", "")
    return str(master).startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; set a scratch one only if unset.

    On a cluster ``spark.checkpoint.dir`` is set by the deployment and is
    used as is; a cluster session without it is an error.  The scratch
    fallback exists only for local-mode sessions (tests, single machine).
    """
    d = checkpoint_dir(spark)
    if d:
        return d
    if not _is_local(spark):
        raise RuntimeError(
            f"{_CKPT_KEY} is not set: name a folder every executor can reach (HDFS, object store); "
            "a machine-local scratch folder is only used for local-mode sessions"
        )
    d = tempfile.mkdtemp(prefix="grantweave-ckpt-")
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    try:
        spark.sparkContext.setCheckpointDir(d)
        return spark.sparkContext.getCheckpointDir() or d
    except Exception:  # pragma: no cover - no SparkContext (connect)
        spark.conf.set(_CKPT_KEY, d)
        return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused path under the checkpoint folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/grantweave/{name}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
    """Write ``df`` to a new snapshot in the shared folder and read it back.

    Cuts lineage so a lost executor re-reads the snapshot instead of
    recomputing the whole upstream plan; state changes write here rather than
    over the table they read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.format(fmt).mode("errorifexists").save(path)
    return spark.read.format(fmt).load(path)
