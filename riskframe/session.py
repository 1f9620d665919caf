"""Session helpers: building a session for tests/bench and finding the shared scratch folder."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "riskframe") -> SparkSession:
    """Session for tests and the bench. On a cluster the submitter owns the session config."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only where the session has none and runs in one process (a local master, as in tests) is it a temporary folder
    of our own; elsewhere executors could not see such a folder, so a cluster must name one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not is_local(sc.master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master {sc.master})")
        configured = tempfile.mkdtemp(prefix="riskframe-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def is_local(master: str) -> bool:
    """One process: local, local[n], local[n,f] or local[*], but not local-cluster[...]."""
    return master == "local" or master.startswith("local[")


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that functions run there by name whatever the
    working directory or the packages installed on the workers. The archive is in the shared folder, where executors
    that start later find it too."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package, held = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskframe-code/riskframe-{uuid.uuid4().hex[:8]}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(held.getvalue()))
    out.close()
    sc.addPyFile(place)
    _SHIPPED.add(sc.applicationId)


#: Bytes of input per partition where a fixed number of partitions is needed.
PARTITION_BYTES = 128 << 20


def input_partitions(df: DataFrame) -> int:
    """How many partitions an ordered pass over ``df`` is dealt to: as many as shuffles have by default, and more where
    the tables it reads are larger. For passes whose number of partitions must stay fixed, which adaptive execution
    then neither merges nor splits."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    # a table without statistics counts as the largest size there is
    return max(least, sum(s for s in sizes if s < 1 << 62) // PARTITION_BYTES)


def drop_scratch(spark: SparkSession) -> None:
    """Remove every scratch table of this application. Results that still read them end with it, so call it when a
    job has written its product."""
    base = spark._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark).rstrip("/") + "/riskframe")
    base.getFileSystem(spark._jsc.hadoopConfiguration()).delete(base, True)


def release(df: DataFrame, name: str) -> None:
    """Remove the scratch table ``name`` that ``df`` reads, once its rows are written on: it would only fill the shared
    disk until the job ends. ``df`` cannot be read after that. Tables of another name or place stay."""
    spark = df.sparkSession
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark).rstrip("/") + "/riskframe")
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        if re.fullmatch(re.escape(name) + "-[0-9a-f]{12}", path.getName()) \
                and fs.makeQualified(base).equals(fs.makeQualified(path.getParent())):
            fs.delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/riskframe/{name}-{uuid.uuid4().hex[:12]}"


#: Most rows of a written file. A scan deals out row groups, and a narrow table of millions of rows that compresses well
#: is one row group: without this limit every later pass over it, and every pass of a learner, is one task's.
ROWS_PER_FILE = 1 << 16


def materialize(df: DataFrame, name: str = "stage", columnar: bool = True) -> DataFrame:
    """Cut lineage before multi-pass statistics: a table written into the shared checkpoint folder.

    A written table survives executor loss (unlike a local checkpoint or an executor cache) and lets the
    statistics passes scan a compact copy instead of re-running the upstream shuffle. The default is Parquet so
    that each later pass reads only the columns it needs (``ReadSchema``) and gets its filters pushed down;
    ``columnar=False`` uses ``DataFrame.checkpoint`` instead (keeps the partitioning of ``df``). A file holds at most
    ``ROWS_PER_FILE`` rows, so scans of a larger table have as many tasks as its rows ask for.
    """
    spark = df.sparkSession
    if not columnar:
        ensure_checkpoint_dir(spark)
        return df.checkpoint(eager=True)
    path = scratch_path(spark, name)
    df.write.option("maxRecordsPerFile", ROWS_PER_FILE).mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
