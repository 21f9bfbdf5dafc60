"""Reading documents, scratch tables in the shared folder, size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Rows of at most this many estimated bytes may be broadcast.
BROADCAST_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def materialise(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Cuts the lineage like a checkpoint, but columnar and compressed; the files
    live where ``spark.checkpoint.dir`` points, so a lost executor costs nothing.
    ``options`` go to the Parquet writer.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list]:
    """``docs`` under reserved column names, those names by the old ones, and the
    expressions that give the old columns back: no helper column can clash."""
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names, [F.col(n).alias(c) for c, n in names.items()]


def release(df: DataFrame) -> None:
    """Remove the scratch files of a materialised frame that nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/agrisentinel/" not in folder:
            raise ValueError(f"{folder} is not a scratch table")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when rows x ``row_bytes`` is under ``limit``.

    ``df`` should be materialised: it is counted.  Beyond the limit the frame is
    returned as it is and Spark shuffles the join.
    """
    if df.count() * row_bytes <= limit:
        return F.broadcast(df)
    return df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
