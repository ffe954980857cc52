"""Tables that cut lineage, written to the folder all executors share.

``spark.checkpoint.dir`` of the session names that folder.  Only where it is
unset (local tests) a temporary folder of this machine is taken.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, readable by every executor."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="lexigrain-")
    return _own[app]


def new_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder, deleted when the program ends."""
    path = f"{shared_dir(spark)}/lexigrain-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back, so later stages do not recompute it.

    A lost executor costs only the tasks it ran: the table is on shared storage.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BYTES = 64 << 20  #: input of a partition that :func:`by_id` makes, as far as the sizes of the tables tell


def input_bytes(df: DataFrame) -> int:
    """Size of the tables and files a plan reads, as its leaves estimate it; rows given from memory, of no known size, do not count."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 62)


def by_id(df: DataFrame, id_col: str) -> DataFrame:
    """``df`` hash-partitioned by its id.

    Moves each text once; whatever is then grouped by the id and something made
    from its row (grams, say) needs no further shuffle, and a small file that is
    one split still keeps all cores busy.  The number of partitions grows with
    the size of the input, so a partition holds about ``BYTES`` of it at any size.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // BYTES))
    return df.repartition(n, id_col)


def sorted_merge(df: DataFrame) -> DataFrame:
    """``df`` to be joined by shuffle.

    For what comes from exploded grams: Spark takes a table after ``explode`` for as
    large as before it, so one of a few MB of text would be broadcast, through the
    driver, with hundreds of rows for each of its own.
    """
    return df.hint("merge")


def discard(df: DataFrame) -> None:
    """Delete the table behind a DataFrame that came from :func:`materialise`."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        hit = [x for x in _written if x[1].split("://")[-1].lstrip("/") == path.split(":", 1)[-1].lstrip("/")]
        for x in hit:
            _delete(*x)
            _written.remove(x)


def discard_path(spark: SparkSession, path: str) -> None:
    """Delete what lies under a path that came from :func:`new_path`."""
    _delete(spark, path)
    _written.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _cleanup() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return
