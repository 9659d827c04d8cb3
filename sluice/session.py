"""Session helpers: building a local session for tests/bench and locating the
shared scratch area (the cluster's ``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "sluice",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench. On a cluster the job's own launcher
    owns the session; library code only reads settings from it."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "16g",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _conf_get(spark: SparkSession, key: str) -> str | None:
    try:
        value = spark.conf.get(key, None)
    except Exception:  # pragma: no cover - conf lookup is best effort
        value = None
    if value:
        return value
    try:
        return spark.sparkContext.getConf().get(key, None)
    except Exception:  # pragma: no cover - e.g. Spark Connect
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    A cluster names it in ``spark.checkpoint.dir``; that value is always used.
    Only when nothing is set and the master is local (tests, the bench) do
    we create our own folder and register it; a cluster run without the
    setting is an error rather than a machine-local folder.
    """
    value = _conf_get(spark, _CHECKPOINT_KEY)
    if not value:
        try:
            value = spark.sparkContext.getCheckpointDir()
        except Exception:  # pragma: no cover
            value = None
    if value:
        return value.rstrip("/")
    master = _conf_get(spark, "spark.master") or ""
    if not master.startswith("local"):
        # executors on other machines cannot share a folder of this one
        raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage for a cluster run")
    value = tempfile.mkdtemp(prefix="sluice-ckpt-")
    try:
        spark.sparkContext.setCheckpointDir(value)
    except Exception:  # pragma: no cover
        pass
    try:
        spark.conf.set(_CHECKPOINT_KEY, value)
    except Exception:  # pragma: no cover - static conf on some deployments
        pass
    return value


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused folder under the shared checkpoint folder.

    Everything a job writes between steps (staged tables, stream checkpoints,
    round-trip files) goes here, so a lost executor or a re-run never meets a
    half-written machine-local path."""
    base = ensure_checkpoint_dir(spark)
    return f"{base}/sluice/{label}-{uuid.uuid4().hex[:12]}"


def session_key(spark: SparkSession) -> str:
    """A stable id of the running application (works without SparkContext)."""
    try:
        return spark.conf.get("spark.app.id")
    except Exception:  # pragma: no cover
        return str(id(spark))
