"""Session helpers: where lineage is cut, and how loop state is materialised."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: list[str] = []  # folders of written tables, in the order they were begun


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names; make one only for local sessions."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="boxloom-checkpoint-")
    context.setCheckpointDir(named)
    return named


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder once, so later reads do not redo its plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def _own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a table that is written inside go with the end of the write; nothing else reads them."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def _new_table(spark: SparkSession) -> str:
    _paths.append(f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}")
    return _paths[-1]


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet in the checkpoint folder and read it back: readers prune columns and know its size."""
    path = _new_table(df.sparkSession)
    with _own_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_in_turn(spark: SparkSession, parts: Iterable[DataFrame]) -> DataFrame:
    """The rows of all `parts` as one written table. `parts` makes them one by one; what was written on the way to a
    part is removed once the part itself is written, so the disk holds the steps of one part at a time."""
    path, schema, begun = _new_table(spark), None, len(_paths)
    for part in parts:
        schema = schema or part.schema
        with _own_shuffles(spark):
            part.write.mode("append").parquet(path)
        for done in _paths[begun:]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(done)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        del _paths[begun:]
    return spark.read.schema(schema).parquet(path)


def written(df: DataFrame) -> DataFrame:
    """`stored`, or a checkpoint where a column has a type that Parquet files cannot hold."""
    return materialise(df) if any("void" in kind or kind == "interval" for _, kind in df.dtypes) else stored(df)
