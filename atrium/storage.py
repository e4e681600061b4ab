"""Tables kept in the folder that all executors share, and this package on the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset and all work is in this process, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="atrium-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = "file://" + own
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that no other table has."""
    return f"{shared_dir(spark)}/atrium-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


#: Whether a query's shuffle files go when it ends, and not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of rows that go to a Python worker at once, 64 MB unless set.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Paths of what has been stored in each open ``passing`` block.
_PASSING: list[list[str]] = []


def stored(df: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back. Its shuffle files go with the write.

    ``batch_bytes``: of how many bytes the Arrow batches are that its Python functions get.

    This cuts the lineage: a lost executor costs a read of the file, not a new run of the plan.
    What is read back has no known partitioning, so a join on it gets an exchange on both sides
    and Spark may split a skewed key there.
    """
    path, conf = new_path(df.sparkSession), df.sparkSession.conf
    wanted = {_CLEANUP: "true"} | ({_BATCH: str(batch_bytes)} if batch_bytes else {})
    before = {k: conf.get(k, None) for k in wanted}
    if _PASSING:
        _PASSING[-1].append(path)
    try:
        for k, v in wanted.items():
            conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def spread(df: DataFrame) -> DataFrame:
    """``df`` for a join of which both sides are dealt out and neither is sent whole to the driver and all executors.

    Spark takes a table for as large as its columns are in the files. Rows made from arrays, and files that compress well,
    are many times that.
    """
    return df.hint("merge")


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are stored inside the block are deleted at its end, but for those that the function it gives is called with."""
    kept: list[str] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table.stored_at)
        return table

    _PASSING.append([])
    try:
        yield keep
    finally:
        paths = _PASSING.pop()
        if _PASSING:
            _PASSING[-1].extend(kept)
        for path in set(paths) - set(kept):
            _delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has stored, once its results are written elsewhere."""
    _delete(spark, f"{shared_dir(spark)}/atrium-{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application, through Spark's file server."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="atrium-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as file:
        for p in sorted(root.rglob("*.py")):
            file.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
