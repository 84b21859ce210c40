"""Spark sessions and what Python workers need."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HOME = Path(__file__).resolve().parent


@functools.cache
def _packed() -> str:
    path = Path(tempfile.mkdtemp(prefix="plumbline-py-")) / "plumbline.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(HOME.rglob("*.py")):
            z.write(f, f.relative_to(HOME.parent))
    return str(path)


def ship(spark: SparkSession) -> None:
    """Python workers import this package: from PYTHONPATH if it is there, else from a zip that Spark hands out."""
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if not any(Path(p).resolve() == HOME.parent for p in paths) and not getattr(spark.sparkContext, "_plumbline", False):
        spark.sparkContext.addPyFile(_packed())
        spark.sparkContext._plumbline = True


def session(master: str = "local[*]", **settings: str) -> SparkSession:
    """A session with adaptive execution, UTC and ANSI semantics; ``settings`` have underscores for dots."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("_", "."): v for k, v in settings.items()}
    return SparkSession.builder.master(master).config(map=conf).getOrCreate()
