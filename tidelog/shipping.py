"""What driver and executors share: the package itself, and folders."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .model import NotSupported

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, so that a worker can import it wherever it runs."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="tidelog-ship-")) / f"{_PACKAGE.name}_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, f"{_PACKAGE.name}/{p.relative_to(_PACKAGE)}")
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that driver and executors share, below ``spark.checkpoint.dir``.

    Where that setting is missing (a single machine, as in tests) a temporary folder is used
    and also given to Spark for its checkpoints.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        else:
            base = "file://" + tempfile.mkdtemp(prefix="tidelog-shared-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def shared_path(spark: SparkSession, purpose: str) -> Path:
    """A fresh folder like :func:`shared_folder`, as a path; the shared folder must be mounted on every machine."""
    url = shared_folder(spark, purpose)
    if "://" in url and not url.startswith("file:"):
        raise NotSupported(f"a store needs a mounted folder, not {url}")
    return Path("/" + url.removeprefix("file:").lstrip("/"))
