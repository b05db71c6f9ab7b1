"""Session helpers: table access, the shared folder and bounded driver reads."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Tables whose row count is fixed by definition (a declared schema, a list of
# names); they are the only ones read whole into the driver.
FIXED_TABLE_ROWS = 20_000


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, wherever the driver was started.

    Workers get the package's parent folder in their path; on a real cluster, where that
    folder may not be there, also a zip of the package, written to the shared folder.
    """
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    known = sc.environment.get("PYTHONPATH", "")
    if str(root) in known.split(os.pathsep):
        return spark
    sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [str(root), known]))
    if not sc.master.startswith("local"):
        base = shared_dir(spark)
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for f in (root / "sparkscape").rglob("*.py"):
                z.write(f, f.relative_to(root))
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{base}/code/sparkscape.zip")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(packed.getvalue()))
        out.close()
        sc.addPyFile(path.toString())
    return spark


def local_session(cores: int = 8, app: str = "sparkscape") -> SparkSession:
    """A local session for tests and the bench."""
    return ship(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's ``spark.checkpoint.dir``.

    Only where the session names none on one machine (tests) a temporary folder is made
    and set; a cluster without one is refused, as its machines share no such folder.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sparkscape-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the lineage ends at files every executor can read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fixed_rows(df: DataFrame, limit: int = FIXED_TABLE_ROWS) -> list:
    """Rows of a table of fixed size; refuses one that outgrew the bound."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"a table meant to have at most {limit} rows is larger")
    return rows
