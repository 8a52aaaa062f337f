"""Session, table access and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


_own: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale directory. Column pruning and filters reach this scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only where that setting is absent, on a single machine (tests, local runs), a folder of our own
    is taken; on a cluster the setting must name a store every executor can reach.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = os.path.join(tempfile.gettempdir(), f"tessera-{spark.sparkContext.applicationId}")
        if own not in _own:
            _own.add(own)
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
    return folder.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one. It goes when the driver ends in good order,
    else by :func:`cleanup` or whoever finds it by the application's id."""
    folder = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"
    if folder not in _own:
        _own.add(folder)
        atexit.register(_quietly, spark, folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def _quietly(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session is gone already
        pass


def cleanup(spark: SparkSession) -> None:
    """Delete every table this application has materialised; for the end of a run."""
    _delete(spark, run_dir(spark))


def materialize(df: DataFrame, name: str = "t", measure: Column | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back. ``measure`` is an aggregate that is
    worked out on the way; its value is the result's ``_tessera_measure``.

    It cuts the lineage like a reliable checkpoint, runs the plan once, stays columnar and
    compressed, and survives the loss of any executor.
    """
    path = f"{run_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    seen = Observation() if measure is not None else None
    (df if seen is None else df.observe(seen, measure.alias("m"))).write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._tessera_path = path
    back._tessera_measure = None if seen is None else seen.get["m"]
    return back


def discard(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote; only for frames that nothing will read again."""
    path = getattr(df, "_tessera_path", None)
    if path:
        _delete(df.sparkSession, path)


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and single-machine runs."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
