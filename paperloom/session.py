"""Getting the library's own code to Python workers, wherever they run."""

from __future__ import annotations

import logging
import resource
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that Python operators find it there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="paperloom-code-")) / "paperloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def give_back(spark: SparkSession) -> None:
    """Full collections in the driver and then in each executor, after which a JVM returns the heap that it no longer uses.

    A JVM keeps what heap its largest step has taken, though its next step may need that memory outside the heap,
    for Python workers. Idle executors get one task each; a busy one may be passed over and keeps its heap.
    """
    sc = spark.sparkContext
    sc._jvm.java.lang.System.gc()
    executors = sc._jsc.sc().getExecutorMemoryStatus().size() - 1  # the driver is in it; a local session has no others
    if executors > 0:
        spark.range(0, executors, 1, executors).selectExpr("java_method('java.lang.System', 'gc')").collect()


def run_logger(name: str, path: str | None = None) -> logging.Logger:
    """A logger to the console and, if named, a file; each line tells the driver's peak memory in MB."""
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    log.propagate = False
    log.handlers.clear()

    class Peak(logging.Filter):
        def filter(self, record: logging.LogRecord) -> bool:
            record.peak_mb = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
            return True

    for handler in (logging.StreamHandler(), *([logging.FileHandler(path)] if path else [])):
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s [%(peak_mb)d MB] %(message)s"))
        handler.addFilter(Peak())
        log.addHandler(handler)
    return log
