"""Named checks, each a Spark job of its own: one that fails while it is planned or while it runs, or that takes too
long, is told as such and stops no other.

A check is a function of the session that gives a DataFrame of results (`status`, `detail`); only the first
`MOST_RESULTS` are taken to the driver, of a check that should have few. Each runs in a thread whose jobs carry a tag
of their own; past the limit the jobs of that tag are cancelled, on the executors too.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

Check = Callable[[SparkSession], DataFrame]
STATUSES = ("ok", "warn", "fail")
RESULTS = "id string, place int, status string, code string, detail string"
MOST_RESULTS = 1000


def run_checks(spark: SparkSession, checks: dict[str, Check], limit_s: float = 600, at_once: int = 4) -> DataFrame:
    """Results in the order of the checks. code is null for a check's own result, else crashed, timed_out or empty."""
    run = uuid.uuid4().hex[:10]

    def one(place: int, name: str, check: Check) -> list[tuple]:
        tag, over = f"check-{run}-{place}", threading.Event()
        context = spark.sparkContext

        def stop():
            over.set()
            context.cancelJobsWithTag(tag)

        context.addJobTag(tag)
        timer = threading.Timer(limit_s, inheritable_thread_target(spark)(stop))
        timer.daemon = True
        timer.start()
        try:
            rows = check(spark).select("status", "detail").take(MOST_RESULTS)
            if over.is_set():
                return [(name, place, "fail", "timed_out", f"more than {limit_s:g} s")]
            if not rows:
                return [(name, place, "fail", "empty", "the check returned no result")]
            return [(name, place, r.status, None, r.detail) for r in rows]
        except Exception as e:  # noqa: BLE001  a defect of the check, told as its result
            if over.is_set():
                return [(name, place, "fail", "timed_out", f"more than {limit_s:g} s")]
            return [(name, place, "fail", "crashed", (str(e).strip().split("\n") or [""])[0][:200])]
        finally:
            timer.cancel()
            context.removeJobTag(tag)

    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        told = [pool.submit(inheritable_thread_target(spark)(one), i, name, check) for i, (name, check) in enumerate(checks.items())]
        rows = [r for x in told for r in x.result()]
    return spark.createDataFrame(rows, RESULTS)


def exit_code(results: DataFrame) -> int:
    """0 when there are results and all are ok or warn; a status that is not known is a failure."""
    statuses = {r.status for r in results.select("status").distinct().collect()}
    return 0 if statuses and statuses <= {"ok", "warn"} else 1
