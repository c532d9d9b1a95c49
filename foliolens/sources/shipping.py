"""Send this package to the executors, which may not have it installed."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import foliolens


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package's source, once for each context.

    The archive lies in the shared folder, so executors that join later get it too. Where
    none is set it is served from a temporary folder of the driver, which Spark sends to
    each executor. A package that was itself loaded from an archive is with the workers
    already.
    """
    context = spark.sparkContext
    root = Path(foliolens.__file__).parent
    if getattr(context, "_foliolens_shipped", False) or not root.is_dir():
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        archive = f"{shared.rstrip('/')}/code-{uuid.uuid4().hex}/foliolens.zip"
        path = context._jvm.org.apache.hadoop.fs.Path(archive)
        stream = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
        stream.write(packed.getvalue())
        stream.close()
    else:
        archive = str(Path(tempfile.mkdtemp(prefix="foliolens-")) / "foliolens.zip")
        Path(archive).write_bytes(packed.getvalue())
    context.addPyFile(archive)
    context._foliolens_shipped = True
