"""Session builder and the few run-time services the operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lodestrata", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan here assumes: ANSI, UTC and adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that setting is absent in local mode (tests, a notebook) a temporary folder is set; on
    any other master, whose executors would each write to a disk of their own, its absence is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
    found = getattr(spark, "_lodestrata_shared", None)
    if found is None:
        found = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
        spark._lodestrata_shared = found
    return found


#: Spark removes what an execution has exchanged once it has ended; otherwise when the driver happens to collect its garbage.
REMOVE_EXCHANGED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, remove_exchanged: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage for results that are read several times; the files live in the shared folder,
    so they survive the loss of an executor. With ``remove_exchanged`` the shuffle files of the write
    do not stay on disk beside its result.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestrata-{uuid.uuid4().hex}"
    before = spark.conf.get(REMOVE_EXCHANGED, None)
    if remove_exchanged:
        spark.conf.set(REMOVE_EXCHANGED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if remove_exchanged:
            spark.conf.unset(REMOVE_EXCHANGED) if before is None else spark.conf.set(REMOVE_EXCHANGED, before)
    _written(spark).append(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._lodestrata_path = path
    return found


def discard(df: DataFrame | None) -> None:
    """Delete the files of one result of ``materialize`` that nothing reads any more; none is fine."""
    if df is not None:
        target, system = _file(df.sparkSession, df._lodestrata_path)
        system.delete(target, True)
        _written(df.sparkSession).remove(df._lodestrata_path)


def _written(spark: SparkSession) -> list[str]:
    if not hasattr(spark, "_lodestrata_written"):
        spark._lodestrata_written = []
    return spark._lodestrata_written


def drop_materialized(spark: SparkSession) -> int:
    """Delete what ``materialize`` has written in this session; call it when its readers are done."""
    paths = _written(spark)
    for path in paths:
        target, system = _file(spark, path)
        system.delete(target, True)
    n = len(paths)
    paths.clear()
    return n


def _file(spark: SparkSession, path: str):
    """A path and its file system, whichever scheme it has."""
    target = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def write_bytes(spark: SparkSession, path: str, body: bytes) -> None:
    """Write a small file on any file system Spark knows, replacing what is there."""
    target, system = _file(spark, path)
    out = system.create(target, True)
    try:
        out.write(bytearray(body))
    finally:
        out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """The content of a small file on any file system Spark knows, null if there is none."""
    target, system = _file(spark, path)
    if not system.exists(target):
        return None
    source = system.open(target)
    try:
        return bytes(source.readAllBytes())
    finally:
        source.close()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> bool:
    """Make this package importable in Python workers that would not find it; True if it was sent.

    Where its folder is on PYTHONPATH (or the package is installed) nothing is sent; otherwise a ZIP
    of its modules is put into the shared folder and added to the session, once.
    """
    import io
    import os
    import site
    import zipfile
    from pathlib import Path

    package = Path(__file__).resolve().parent
    root = str(package.parent)
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + site.getsitepackages()
    if root in known or getattr(spark.sparkContext, "_lodestrata_shipped", False):
        return False
    from pyarrow import fs

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    target = f"{shared_dir(spark)}/lodestrata-{uuid.uuid4().hex}.zip"
    if "://" in target:
        system, inner = fs.FileSystem.from_uri(target)
    else:
        system, inner = fs.LocalFileSystem(), target
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    with system.open_output_stream(inner) as out:
        out.write(buffer.getvalue())
    spark.sparkContext.addPyFile(target)
    spark.sparkContext._lodestrata_shipped = True
    return True
