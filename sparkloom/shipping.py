"""Makes this package importable in Python workers, wherever the driver was started."""

from __future__ import annotations

import hashlib
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package, as a zip of its sources, to the files of the application; once, so that all tasks run the same."""
    application = spark.sparkContext.applicationId
    if application in _sent:
        return
    root = Path(__file__).resolve().parent
    files = sorted(root.rglob("*.py"))
    digest = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:16]
    target = Path(tempfile.mkdtemp(prefix="sparkloom-code-")) / f"sparkloom_{digest}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in files:
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _sent.add(application)
