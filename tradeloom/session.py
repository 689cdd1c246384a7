"""Session settings and the shared folder for tables written between steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def build_session(app: str = "tradeloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the operators rely on.

    Shuffle width and memory belong to the cluster; they are only set here for
    local runs. AQE coalesces small partitions, turns shuffled joins into
    broadcasts once the real size is known, and splits skewed join partitions
    even when that costs another shuffle. Files are taken to grow fourfold in
    memory, so that a compressed table is not broadcast by its size on disk.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.sources.fileCompressionFactor", "4.0")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder; on a
    cluster a machine-local folder would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tradeloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Rows of a bucket of a table that is joined again and again.
ROWS_PER_BUCKET = 100_000
#: Input files per shuffle partition, and the most shuffled data that AQE may put together for one task.
INPUT_PER_PARTITION, SHUFFLED_PER_TASK = 4 << 20, 24 << 20


def widen_shuffles(spark: SparkSession, paths: Sequence[str]) -> int:
    """At least one shuffle partition per 4 MB of input files, so that a task's share does not grow with the input.

    A session's fixed number of partitions holds ever more rows each, which then
    spill in every sort and aggregate. The number is only raised, never lowered;
    with it the size AQE coalesces to is held at 24 MB, as rows take some ten times their shuffled size in a sort or a hash table.
    """
    hadoop, found = spark.sparkContext._jvm.org.apache.hadoop.fs, 0
    for path in paths:
        target = hadoop.Path(path)
        found += target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
    wanted, key, advisory = -(-found // INPUT_PER_PARTITION), "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if wanted > int(spark.conf.get(key)):
        spark.conf.set(key, str(wanted))
        held = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(advisory))
        spark.conf.set(advisory, str(min(held, SHUFFLED_PER_TASK)))
    return int(spark.conf.get(key))


class Workspace:
    """Tables written to the shared folder for one run, dropped one by one or all at the end.

    Writing cuts the lineage in a way that survives lost executors, and a written
    table tells the planner its real size.
    """

    def __init__(self, spark: SparkSession, tag: str) -> None:
        self.spark, self.tag = spark, tag
        self.held: dict[int, tuple[DataFrame, str, str | None]] = {}

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *error) -> None:
        self.drop(*[df for df, _, _ in self.held.values()])

    def write(self, df: DataFrame) -> DataFrame:
        path = fresh_path(self.spark, self.tag)
        df.write.parquet(path)
        kind = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
        return self._hold(self.spark.read.schema(kind).parquet(path), path, None)

    def write_bucketed(self, df: DataFrame, key: str, rows: int) -> DataFrame:
        """Stored in buckets of ``key``, one file each and as many as the ``rows`` need: joins and sums by it need no shuffle."""
        buckets = max(1, -(-rows // ROWS_PER_BUCKET))
        path, name = fresh_path(self.spark, self.tag), f"{self.tag}_{uuid.uuid4().hex}"
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
        return self._hold(self.spark.table(name), path, name)

    def _hold(self, df: DataFrame, path: str, name: str | None) -> DataFrame:
        self.held[id(df)] = (df, path, name)
        return df

    def drop(self, *written: DataFrame) -> None:
        """Remove written tables that nothing reads any more."""
        for df in written:
            _, path, name = self.held.pop(id(df))
            if name:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it is in."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """A few in-code rows as a local relation.

    The planner knows its size and can broadcast it. A table made from a Python
    list is an RDD of unknown size, and joining it would shuffle the other side.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)
    columns = list(zip(*rows)) if rows else [[] for _ in arrow]
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), kind)


def materialise(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of the written table.

    This cuts lineage in a way that survives lost executors. The scan also
    carries the real file size, so the planner broadcasts it only when it is
    below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it otherwise.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
