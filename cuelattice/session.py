"""Session settings and lineage cutting shared by every job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BLOCK_ROWS_KEY = "cuelattice.series.blockRows"
DEFAULT_BLOCK_ROWS = 1 << 16
# Most rows of a key, or of a value range of it, that a percentile may order in one task.
DIRECT_ROWS_KEY = "cuelattice.percentile.directRows"


def build_session(app: str = "cuelattice", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the jobs expect; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. A machine-local folder is only
    accepted for a local master, because executors on other machines could not read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="cuelattice-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back: the lineage ends at durable files,
    so a lost executor re-reads instead of recomputing, and two readers see the same rows."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, label: str, by: list[str], sort: list[str], buckets: int, dealt: bool = False) -> DataFrame:
    """Write ``df`` bucketed by ``by`` so later windows and joins on those columns need no shuffle. ``dealt``: it is partitioned so already."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{name}"
    out = (df if dealt else df.repartition(buckets, *by)).write.option("path", path).format("parquet").bucketBy(buckets, *by)
    (out.sortBy(*sort) if sort else out).saveAsTable(name)
    return spark.table(name)


def block_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(BLOCK_ROWS_KEY, str(DEFAULT_BLOCK_ROWS)))


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Shuffle by ``cols`` to the session's full number of partitions.

    For rows that are few but expand or cost much CPU: without the number, adaptive execution would
    merge them into one task because they are small in bytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)
