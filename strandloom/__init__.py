"""Molecule-level deduplication and interval analytics on PySpark DataFrames."""

import os
from pathlib import Path


def _let_workers_import() -> None:
    """Python workers find the package where the driver found it, whether Spark has started already or not."""
    from pyspark import SparkContext

    root = str(Path(__file__).resolve().parent.parent)
    running = SparkContext._active_spark_context
    for env in (os.environ, *([running.environment] if running else [])):
        if root not in (paths := [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]):
            env["PYTHONPATH"] = os.pathsep.join([root, *paths])


_let_workers_import()
