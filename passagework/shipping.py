"""Sending these packages to executors that do not have them installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[tuple[str, str]] = set()


def ship(spark: SparkSession, *folders: str) -> None:
    """Add package folders to the Python path of the application's workers, each once."""
    app = spark.sparkContext.applicationId
    folders = [f.rstrip("/") for f in folders or [os.path.dirname(os.path.abspath(__file__))]]
    folders = [f for f in folders if (app, f) not in _shipped]
    if not folders:
        return
    name = f"code_{'_'.join(os.path.basename(f) for f in folders)}.zip"
    path = os.path.join(tempfile.mkdtemp(prefix="passagework-code-"), name)
    with zipfile.ZipFile(path, "w") as archive:
        for folder in folders:
            base = os.path.dirname(folder)
            for where, _, names in os.walk(folder):
                for name in sorted(n for n in names if n.endswith(".py")):
                    full = os.path.join(where, name)
                    archive.write(full, os.path.relpath(full, base))
    spark.sparkContext.addPyFile(path)
    _shipped.update((app, f) for f in folders)
