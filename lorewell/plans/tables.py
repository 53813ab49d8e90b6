"""Tables between stages, in the folder that the whole cluster shares, and the package on its workers."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and all of Spark runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lorewell"))
    return str(sc.getCheckpointDir())


def stored(df: DataFrame) -> DataFrame:
    """df written once and read back: its lineage ends here, and a lost executor loses none of it."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lorewell_path = path  # type: ignore[attr-defined]
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by stored() that nothing will read again."""
    path = getattr(df, "_lorewell_path", None)
    if path:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def packed() -> bytes:
    """The package's modules as a zip file."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(PACKAGE)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join(os.path.basename(PACKAGE), os.path.relpath(full, PACKAGE)))
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once a session: a zip in the shared folder that Spark hands to every executor."""
    sc = spark.sparkContext
    if getattr(sc, "_lorewell_shipped", False) or not os.path.isdir(PACKAGE):  # a zip itself is on the path already
        return
    path = f"{shared_dir(spark)}/lorewell-{uuid.uuid4().hex}.zip"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(sc._jsc.hadoopConfiguration()).create(p)
    stream.write(bytearray(packed()))
    stream.close()
    sc.addPyFile(path)
    sc._lorewell_shipped = True  # type: ignore[attr-defined]
