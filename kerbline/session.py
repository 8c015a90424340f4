"""Session construction and the settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings every kerbline session needs for right results or for skew handling.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app_name: str = "kerbline", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on and the clock pinned to UTC.

    Timestamps are local wall-clock readings without a zone, so the session zone must
    not shift them. Keyword arguments are extra settings with ``__`` for the dot.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in REQUIRED.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Shared folder for cut lineage and streaming state.

    The cluster names it in ``spark.checkpoint.dir``; ``fallback`` is used only where
    that setting is absent (unit tests).
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if fallback is None:
        raise ValueError("spark.checkpoint.dir is not set and no fallback was given")
    return fallback
