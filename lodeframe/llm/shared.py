"""Written tables in the folder that the cluster shares, samples, spare column names, and
memory that tasks give back."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset on one machine, as in tests, a
    new temporary folder is set; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def keep_table(df: DataFrame, **options: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: its lineage is cut, and
    nothing is lost with an executor. options: of Spark's writer."""
    path = f"{shared_dir(df.sparkSession)}/lodeframe-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(*tables: DataFrame) -> None:
    """Deletes tables of `keep_table` once all that was read from them is written."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/lodeframe-" in path:
                there = spark._jvm.org.apache.hadoop.fs.Path(path)
                there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(there, True)


def about(df: DataFrame, rows: int, key: Column) -> DataFrame:
    """All rows of df if it has at most `rows`; else those whose key's hash falls in the
    share that gives about `rows`. Rows with one key stay together."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(rows / n * (1 << 30)))


def spare(name: str, *frames: DataFrame) -> str:
    """The name, with as many underscores more as no column of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function for mapInArrow, whose tasks give freed memory back to the system at
    their end. Spark keeps a Python worker for later tasks, of other stages too, and the
    worker's allocators keep the pages of its largest task so far."""

    def whole(batches):
        forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.malloc_trim(0)


#: What a worker remembers from task to task, and of which stage.
_REMEMBERED: dict[str, tuple[int, object]] = {}


def stage() -> int:
    """The stage of this task; -1 outside of tasks."""
    task = TaskContext.get()
    return task.stageId() if task else -1


def remembered(name: str, make: Callable[[], object]):
    """make(), once for all tasks of a stage that a worker gets."""
    if name not in _REMEMBERED:
        _REMEMBERED[name] = stage(), make()
    return _REMEMBERED[name][1]


def forget() -> None:
    """What tasks of other stages remembered goes."""
    now = stage()
    for name in [n for n, (then, _) in _REMEMBERED.items() if then != now]:
        del _REMEMBERED[name]
