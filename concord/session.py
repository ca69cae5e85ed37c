"""Session defaults and the one way this package cuts lineage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: The application that has been sent the package.
_SHIPPED: dict[str, object] = {}


def local_session(cores: str = "8", app: str = "concord", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session without that setting gets a fresh folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as a reliable checkpoint and continue from there.

    The shuffle files of the step go with its end.
    """
    shared_folder(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        # The plan is made anew, since the setting counts when a plan is made.
        return df.select("*").checkpoint(eager=True)


#: Removes a query's shuffle files when its action ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Actions on plans made inside leave no shuffle files.

    Otherwise these stay until the driver happens to collect its garbage, and a
    job of many steps needs the disk of all of them.
    """
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` to a fixed number of tasks, for steps that do much work on few bytes.

    Runtime coalescing goes by bytes and would leave such a step to a few tasks.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A short parameter table as part of the plan itself, so reading it runs no job."""
    fields = T.StructType.fromDDL(schema)
    cols = [
        F.lit([r[i] for r in rows]).cast(T.ArrayType(f.dataType)).alias(f.name) for i, f in enumerate(fields)
    ]
    zipped = spark.sql("SELECT 1 AS one").select(F.explode(F.arrays_zip(*cols)).alias("r"))
    return zipped.select("r.*")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster, once per application.

    Spark carries the archive itself, so executors need no folder in common with
    the driver. Workers import the package by name in every pandas function.
    """
    context = spark.sparkContext
    if _SHIPPED.get("application") == context.applicationId:
        return
    root = Path(__file__).resolve().parent
    sources = [p for p in root.rglob("*.py")]
    top = root.parent / "corpus_pipeline.py"
    # Executors fetch the archive when they start, so its folder stays until the driver ends.
    folder = tempfile.TemporaryDirectory(prefix="package-")
    archive = Path(folder.name) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for p in sources:
            out.write(p, p.relative_to(root.parent))
        if top.exists():
            out.write(top, top.name)
    context.addPyFile(str(archive))
    _SHIPPED.update(application=context.applicationId, folder=folder)
