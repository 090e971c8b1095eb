"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors' Python workers, once for each application, so that they needn't find it installed."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        here = Path(__file__).parent
        target = f"{tempfile.mkdtemp()}/{here.name}-{uuid.uuid4().hex[:8]}.zip"  # the driver serves it to executors as long as it runs
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        sc.addPyFile(target)
        _shipped.add(sc.applicationId)
    return spark


def session(app: str = "byteloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC, unless the given settings say otherwise."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"} | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
