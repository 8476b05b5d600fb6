"""Where intermediate tables go, and how the package reaches the executors."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}
#: Short rows that one task writes, and the fewest files of a table.
ROWS, FILES = 250_000, 8


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``, which all executors share.

    Only where that setting is absent and all runs in one process (tests) a temporary folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tidewater-"))
    return f"{base.rstrip('/')}/tidewater-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str, name: str, most: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet below ``path`` and read it back: lineage ends at the files.

    Where the caller knows that it has at most ``most`` short rows, they go to a file for each ``ROWS`` of these
    (``FILES`` at least), in place of one for each shuffle partition, however empty.
    """
    target = f"{path}/{name}"
    schema = df.schema
    if most is not None:
        df = df.coalesce(max(FILES, -(-most // ROWS)))
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(schema).parquet(target)


def ship(spark: SparkSession) -> None:
    """Make a session fit for Python tasks over long texts.

    The package is sent to the executors once per application, so that tasks can import it, and
    where the user has set no bounds of their own, Arrow batches hold at most 1,000 rows and about 4 MB, as whole documents
    would make Spark's default of 10,000 rows too large for small executors.
    """
    for key, default, own in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", str(2**31 - 1), str(1 << 22))):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, own)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    folder = tempfile.mkdtemp(prefix="tidewater-ship-")
    target = os.path.join(folder, "tidewater_src.zip")
    Path(target).write_bytes(blob.getvalue())
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
