"""Session helpers: recommended configuration and a shared materialisation folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job wants; applied only by ``build_session`` (tests, bench).
# A cluster session keeps whatever its operator configured.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[8]", app: str = "valuelens", shuffle_partitions: int = 8,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(RECOMMENDED_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    A cluster names it in ``spark.checkpoint.dir``; it is read, never replaced.
    Only a local-mode session without one (unit tests) gets a fresh private folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="valuelens-ckpt-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Cut lineage by writing ``df`` as Parquet under the shared checkpoint folder.

    Used where a later step must see exactly the same rows as an earlier action
    (ids that depend on physical partitioning). The write is one job; the read-back
    is a plain scan, so a lost executor only re-reads files.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/valuelens/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files of one ``materialize`` once nothing reads them any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete_folder(df.sparkSession, folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cleanup_materialized(spark: SparkSession) -> None:
    """Delete the stages written by ``materialize`` (call once no DataFrame built from
    them is needed any more, e.g. at the end of a job or bench run)."""
    base = ensure_checkpoint_dir(spark).rstrip("/") + "/valuelens"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        fs.delete(path, True)


def default_parallelism(spark: SparkSession) -> int:
    """Partition count for explicit range partitioning (never merged by AQE)."""
    try:
        value = int(spark.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # pragma: no cover - conf always present in practice
        value = 200
    return max(1, value)
