"""Session helpers that do not depend on any operator."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lattiq-code-")) / "lattiq_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for f in sorted(home.rglob("*.py")):
            out.write(f, f"{home.name}/{f.relative_to(home)}")
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)
