"""Session, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows times its row width stay under this many bytes.
BROADCAST_BYTES = 32 << 20
_shipped = ""


def builder(cores: str | int = "*", app: str = "newsloom") -> SparkSession.Builder:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )


def ship(spark: SparkSession) -> None:
    """Hands this package to the session's Python workers, once per application; on a cluster they don't share its folder."""
    global _shipped
    app = spark.sparkContext.applicationId
    if _shipped == app:
        return
    root = Path(__file__).resolve().parent
    made = Path(tempfile.mkdtemp(prefix="newsloom-code-"))
    atexit.register(shutil.rmtree, made, True)
    with zipfile.ZipFile(made / "newsloom_code.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(made / "newsloom_code.zip"))
    _shipped = app


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``; columns are pruned by the plan that follows."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        made = tempfile.mkdtemp(prefix="newsloom-")
        atexit.register(shutil.rmtree, made, True)
        sc.setCheckpointDir(f"file://{made}")
    return sc.getCheckpointDir()


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and leaves exact file sizes from which the planner
    chooses joins. An empty frame keeps its schema.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/newsloom/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``, wherever the session's file system keeps it."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a written table, or a folder of them, wherever the session's file system keeps it."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


class Scratch:
    """Intermediate tables of one operation, written into the shared folder and removed when it ends."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.path = spark, f"{shared_dir(spark)}/newsloom/{label}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        """``df`` as a written table, as ``materialize`` does it."""
        self.n += 1
        df.write.option("compression", "snappy").parquet(f"{self.path}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        discard(self.spark, self.path)


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", row_bytes: int = 64, salts: int = 16) -> DataFrame:
    """Join a large, perhaps skewed side to a one-row-per-key side.

    The small side is counted. Under ``BROADCAST_BYTES`` it is broadcast; beyond that the large side gets a salt
    and the small side one copy per salt, so that no key, however hot, ends in one task.
    """
    if small.count() * row_bytes <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), keys, how)
    copies = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in big.columns if c not in keys][:4] or [F.lit(0)]), F.lit(salts)).cast("int"))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
