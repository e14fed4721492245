"""Command line: demo, bench, health, ingest, serve."""

from __future__ import annotations

import argparse
import json
import logging
import sys
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators import clustering
from .plans import pipeline, readmodels
from .scratch import materialise
from .settings import Settings
from .sources import logs, sinks


def session() -> SparkSession:
    spark = SparkSession.builder.appName("logtide").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def health_of(result: pipeline.Result, settings: Settings) -> dict:
    row = readmodels.health(result.lines, clustering.new_incidents(result.clusters), settings=settings).first().asDict()
    row["severity_hist"] = {r.severity: r["count"] for r in readmodels.severity_histogram(result.lines).orderBy("severity").collect()}
    row["top_components"] = {r.component: r["count"] for r in readmodels.top_components(result.lines).collect()}
    return row


def report(result: pipeline.Result, settings: Settings, top: int) -> str:
    h = health_of(result, settings)
    out = [f"logs {h['total_logs']}  templates {h['unique_templates']}  error rate {h['error_rate']:.1%}  anomalies {h['anomalies']}  new incident types {h['new_incident_types']}"]
    out += [f"{r['count']:>8}  {r.template}" for r in readmodels.top_templates(readmodels.rollup(result.lines), top).collect()]
    out += [f"{r.label}: {r.members} lines, {r.sample_template}" for r in clustering.new_incidents(result.clusters).orderBy(F.desc("members")).collect()]
    return "\n".join(out)


def server(result: pipeline.Result, settings: Settings, host: str, port: int) -> ThreadingHTTPServer:
    """Read models over HTTP (JSON; ``/metrics`` as text), and ``POST /ingest`` of a batch of lines.

    A batch is a small job: its lines are written beside those at hand and the pipeline runs over both, so
    the read models show them.  Streams of lines belong to ``streaming``.
    """
    now = {"result": result}
    busy = threading.Lock()

    def incidents():
        return clustering.new_incidents(now["result"].clusters).drop("centroid")

    tables = {
        "/incidents": incidents,
        "/templates": lambda: readmodels.top_templates(readmodels.rollup(now["result"].lines)),
        "/anomalies": lambda: readmodels.recent_anomalies(now["result"].lines, settings=settings),
        "/alerts": lambda: readmodels.recent_alerts(now["result"].alerts, settings=settings),
    }

    def ingest(lines: list[str], source: str) -> dict:
        spark = now["result"].lines.sparkSession
        batch = logs.from_batches(spark.createDataFrame([(source, lines)], "source string, lines array<string>"))
        batch = materialise(batch.select(F.col("id").cast("string").alias("id"), "line", "source", F.col("ts").cast("timestamp").alias("ts")), "ingested")
        with busy:
            before = now["result"].lines.select(F.col("id").cast("string").alias("id"), "line", "source", F.col("ts").cast("timestamp").alias("ts"))
            now["result"] = pipeline.run(before.union(batch), settings)
            found = now["result"].lines.join(batch.select("id"), "id", "left_semi").where("is_anomaly").count()
        return {"ingested": len(lines), "anomalies": found}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            path, kind = self.path.split("?")[0], "application/json"
            if path in tables:
                body = "[" + ",".join(r.value for r in tables[path]().select(F.to_json(F.struct("*")).alias("value")).collect()) + "]"
            elif path == "/health":
                body = json.dumps(health_of(now["result"], settings))
            elif path == "/healthz":
                body = json.dumps({"status": "ok", "version": __version__})
            elif path == "/metrics":
                lines = now["result"].lines
                shown = sinks.prometheus(readmodels.health(lines, incidents(), settings=settings), readmodels.severity_histogram(lines))
                body, kind = "\n".join(r.line for r in shown.orderBy("at").collect()) + "\n", "text/plain"
            else:
                return self.send_error(404)
            self.answer(body, kind)

        def do_POST(self):  # noqa: N802
            if self.path != "/ingest":
                return self.send_error(404)
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
                lines, source = body["lines"], body.get("source", "api")
                if not isinstance(source, str) or not isinstance(lines, list) or not all(isinstance(x, str) for x in lines):
                    raise ValueError
            except (ValueError, KeyError, TypeError, AttributeError):
                return self.send_error(422, "expected {lines: [string], source: string}")
            self.answer(json.dumps(ingest(lines, source)), "application/json")

        def answer(self, body: str, kind: str):
            self.send_response(200)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *a):
            logging.getLogger("logtide").debug(*a)

    return ThreadingHTTPServer((host, port), Handler)


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="logtide", description="Log telemetry analytics on Spark")
    p.add_argument("--version", action="version", version=f"logtide {__version__}")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--seed", type=int, default=7)
    sub = p.add_subparsers(dest="command", required=True)
    for name, count in (("demo", 5000), ("bench", 50_000), ("health", 5000), ("serve", 5000)):
        c = sub.add_parser(name)
        c.add_argument("-c", "--count", type=int, default=count)
        if name == "demo":
            c.add_argument("--top", type=int, default=8)
        if name == "serve":
            c.add_argument("--host", default="127.0.0.1")
            c.add_argument("--port", type=int, default=8000)
    c = sub.add_parser("ingest")
    c.add_argument("file", help="text file or folder; - for standard input")
    c.add_argument("--source", default="file")
    return p


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    logging.basicConfig(level="DEBUG" if args.verbose else "WARNING")
    spark, settings, began = session(), Settings.from_env(), time.time()
    if args.command != "ingest":
        lines = logs.generate(spark, args.count, args.seed)
    elif args.file == "-":
        lines = logs.from_lines(spark, [x for x in (raw.rstrip("\n") for raw in sys.stdin) if x], args.source)
    else:
        lines = logs.read_text(spark, args.file, args.source)
    result = pipeline.run(lines, settings)
    if args.command == "demo":
        print(report(result, settings, args.top))
    elif args.command == "serve":
        server(result, settings, args.host, args.port).serve_forever()
    elif args.command == "bench":
        h = health_of(result, settings)
        took = time.time() - began
        print(json.dumps({"logs": h["total_logs"], "seconds": round(took, 2), "logs_per_second": round(h["total_logs"] / took), "templates": h["unique_templates"], "anomalies": h["anomalies"], "incidents": h["new_incident_types"]}))
    else:
        print(json.dumps(health_of(result, settings)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
