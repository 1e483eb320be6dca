"""Tables that cut lineage.

Iterative operators write each round to the shared folder that the cluster names in
``spark.checkpoint.dir`` and read it back, so the plan stays short and a lost executor costs
one round at most.  Only where the setting is absent on a local master (tests, a laptop) a
folder of the machine is used instead; a cluster without the setting is an error.

Tables that no result reads any more are deleted: by ``discard``, at the end of a ``scope``,
and all that are left when the process ends.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_fallback: dict[str, str] = {}
_stored: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} see")
    key = spark.sparkContext.applicationId
    if key not in _fallback:
        _fallback[key] = "file://" + tempfile.mkdtemp(prefix="tessellum-")
        atexit.register(_remove_local, _fallback[key])
    return _fallback[key]


def _remove_local(url: str) -> None:
    import shutil

    shutil.rmtree(url.removeprefix("file://"), ignore_errors=True)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back with the same schema."""
    return load(df.sparkSession, store(df, name), df)


def store(df: DataFrame, name: str = "table") -> str:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _stored:
        atexit.unregister(_release_at_exit)
        atexit.register(_release_at_exit)  # after the gateway's own handler, so it runs before that
    _stored[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    return path


def store_measuring(df: DataFrame, name: str, **measures: Column) -> tuple[str, dict]:
    """``store``, and aggregates over the rows written; the write itself computes them."""
    seen = Observation()
    path = store(df.observe(seen, *[m.alias(k) for k, m in measures.items()]), name)
    return path, {k: seen.get[k] for k in measures}


def store_counting(df: DataFrame, name: str, **conditions: str) -> tuple[str, dict[str, int]]:
    """``store``, and how many of the rows written meet each condition."""
    path, n = store_measuring(df, name, **{k: F.count_if(F.expr(c)) for k, c in conditions.items()})
    return path, {k: int(v) for k, v in n.items()}


def load(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ``store`` that no later plan reads."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    _stored.pop(path, None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """``with scope(spark) as keep``: what is stored inside is deleted at the end, but for the tables of ``keep(df, name)``."""
    before, kept = set(_stored), set()

    def keep(df: DataFrame, name: str = "result") -> DataFrame:
        path = store(df, name)
        kept.add(path)
        return load(spark, path, df)

    try:
        yield keep
    finally:
        for path in [p for p in _stored if p not in before and p not in kept]:
            discard(spark, path)


def release(spark: SparkSession) -> None:
    """Delete every table this process has stored; results that still read them become unusable."""
    for path in list(_stored):
        discard(spark, path)


def _release_at_exit() -> None:
    for path, spark in list(_stored.items()):
        try:
            discard(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; what lies on this machine can still go
            if path.startswith("file://"):
                _remove_local(path)


def local_path(url: str) -> str:
    return os.path.abspath(url.removeprefix("file://"))
