"""One place for the session settings that tests, the bench and examples use."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session in UTC with AQE; on a cluster, bring your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("marginalia")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()
_own: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder spark.checkpoint.dir; in a folder of our own only in local mode (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not shared and not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="marginalia-"))
    return f"{(shared or _own[0]).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a session, once, so that its functions import there wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="marginalia-")) / "marginalia.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
