"""Gauges of running streams: rate, delay, events in flight, and a stop of streams that make no progress."""

from __future__ import annotations

import json
import logging
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger("changeloom")
#: Seconds without a finished task, with events in flight, after which a stream counts as stuck.
STUCK_AFTER = 1800


class Gauges(StreamingQueryListener):
    """Follows a session's streams: events per second, seconds behind the log, and events read but not yet written."""

    def __init__(self, task: str, clock=time.time):
        self.task, self.clock = task, clock
        self.qps, self.delay, self.rows, self.batch, self.at = 0.0, 0.0, 0, -1, clock()
        self.in_flight, self.failed, self.tasks = 0, None, -1

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.at = self.clock()

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.progress(json.loads(event.progress.json))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.at, self.in_flight = self.clock(), 0

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.failed, self.in_flight = event.exception, 0

    def progress(self, p: dict) -> None:
        self.qps, self.batch = int(p.get("processedRowsPerSecond") or 0), p.get("batchId", -1)
        self.rows += p.get("numInputRows") or 0
        self.in_flight, self.at = 0, self.clock()

    def read(self, rows: int, latest: int | None) -> None:
        """A batch of ``rows`` events, the last of log time ``latest`` (seconds), is being written."""
        self.in_flight = rows
        if latest is not None:
            self.delay = max(0, int(self.clock()) - latest)

    def stuck(self) -> bool:
        return self.in_flight > 0 and self.clock() - self.at > STUCK_AFTER

    def text(self) -> str:
        """The gauges in the text form that scrapers read."""
        values = {"task_qps": self.qps, "task_delay": self.delay, "task_in_flight": self.in_flight, "task_stuck": int(self.stuck()), "task_events_total": self.rows}
        return "".join(f'# TYPE {n} {"counter" if n.endswith("total") else "gauge"}\n{n}{{task="{self.task}"}} {v}\n' for n, v in values.items())


def serve(gauges: Gauges, port: int) -> ThreadingHTTPServer:
    """Answers GET /metrics on the driver; port 0 takes a free one. Call ``shutdown`` to end it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            body = gauges.text().encode() if self.path == "/metrics" else b""
            self.send_response(200 if body else 404)
            self.send_header("Content-Type", "text/plain; version=0.0.4")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_: object) -> None:
            return

    server = ThreadingHTTPServer(("", port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def watched(query, gauges: Gauges, spark: SparkSession, seconds: float = 1.0) -> None:
    """Waits for a stream's end; one that is stuck (no task ends, for STUCK_AFTER) is stopped and fails."""
    tracker = spark.sparkContext.statusTracker()
    while not query.awaitTermination(seconds):
        stages = tracker.getActiveStageIds()
        done = sum((i << 20) + (info.numCompletedTasks if (info := tracker.getStageInfo(i)) else 0) for i in stages)
        if done != gauges.tasks:
            gauges.tasks, gauges.at = done, gauges.clock()
        if gauges.stuck():
            log.error("stream stuck with %d events in flight", gauges.in_flight)
            query.stop()
            raise TimeoutError("the stream makes no progress")
