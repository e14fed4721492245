"""Severity and component of raw lines, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .masking import bound

#: Ordinals and names of severities.
SEVERITIES = ("TRACE", "DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
#: Level names, lower-cased, by ordinal; any other name is INFO (2).
LEVEL_NAMES = {
    0: ("trace", "trc"),
    1: ("debug", "dbg"),
    2: ("info", "information", "notice"),
    3: ("warn", "warning"),
    4: ("error", "err", "fail", "failed"),
    5: ("critical", "crit", "fatal", "emergency", "emerg", "panic"),
}
#: Level tokens looked for as whole words, case kept.
LEVEL_TOKENS = ("TRACE", "DEBUG", "INFO", "NOTICE", "WARN", "WARNING", "ERROR", "ERR", "FATAL", "CRIT", "CRITICAL", "PANIC", "EMERG")
#: Cues by severity, looked for in lower-cased lines without a level token, worst first.
CUES = (
    (5, ("panic", "fatal", "segfault", "oom", "kernel panic", "data loss", "corruption", "outage", "unrecoverable", "deadlock", "out of memory")),
    (4, ("error", "failed", "failure", "exception", "timeout", "timed out", "refused", "denied", "unreachable", "cannot", "could not", "reset by peer", "5xx", "500", "503")),
    (3, ("warn", "retry", "retrying", "slow", "deprecated", "throttl", "backoff", "degraded", "high latency", "queue full")),
)
#: Components and their cues; the most distinct cues win, the earlier of equals.
COMPONENTS = {
    "nginx": ("nginx", "upstream", "http", "request", "get ", "post ", "referrer"),
    "kernel": ("kernel", "cpu", "memory", "oom", "segfault", "syscall", "irq"),
    "postgres": ("postgres", "postgresql", "psql", "query", "deadlock", "vacuum", "wal"),
    "kafka": ("kafka", "partition", "broker", "consumer", "offset", "isr", "topic"),
    "redis": ("redis", "cache", "eviction", "rdb", "aof", "keyspace"),
    "auth": ("auth", "login", "token", "unauthorized", "forbidden", "credential", "session"),
    "kubelet": ("kubelet", "pod", "container", "k8s", "kube", "readiness", "liveness", "oomkilled"),
    "api": ("api", "endpoint", "handler", "grpc", "rpc", "gateway"),
    "network": ("connection", "socket", "tcp", "dns", "packet", "route", "tls", "handshake"),
    "storage": ("disk", "volume", "mount", "inode", "fsync", "s3", "block"),
}


def level_token(line: Column) -> Column:
    """The first level token of the line, or the empty string."""
    return F.regexp_extract(line, rf"(?U)\b({'|'.join(LEVEL_TOKENS)})\b", 1)


def severity_of_name(name: Column) -> Column:
    """Ordinal of a level name, whatever its case and outer blanks."""
    low = F.lower(F.trim(name))
    out = F.when(F.lit(False), 2)
    for ordinal, names in LEVEL_NAMES.items():
        out = out.when(low.isin(*names), ordinal)
    return out.otherwise(2)


def severity(line: Column) -> Column:
    """Severity 0 to 5: by level token, else by the worst cue, else INFO."""

    def cued(low):
        out = F.when(F.lit(False), 2)
        for ordinal, cues in CUES:
            out = out.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(c)) for c in cues)), ordinal)
        return out.otherwise(2)

    return bound(level_token(line), lambda token: F.when(token != "", severity_of_name(token)).otherwise(bound(F.lower(line), cued))).cast("int")


def severity_name(ordinal: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, SEVERITIES)), ordinal), ordinal.cast("string"))


def component(line: Column) -> Column:
    """Component with the most distinct cues in the line; ``other`` without any."""

    def hits(low):
        return F.array(*(sum((F.contains(low, F.lit(x)).cast("int") for x in cues[1:]), F.contains(low, F.lit(cues[0])).cast("int")) for cues in COMPONENTS.values()))

    def named(found):
        out = F.when(found["most"] == 0, "other")
        for i, name in enumerate(COMPONENTS):
            out = out.when(F.get(found["n"], F.lit(i)) == found["most"], name)
        return out

    return bound(bound(bound(F.lower(line), hits), lambda n: F.struct(n.alias("n"), F.array_max(n).alias("most"))), named)


class Classifier(Protocol):
    """Builds the severity and component columns of a line (and its template)."""

    def columns(self, line: Column, template: Column) -> tuple[Column, Column]: ...


class LexicalClassifier:
    def columns(self, line: Column, template: Column) -> tuple[Column, Column]:
        return severity(line), component(line)


class OnnxClassifier:
    """Severity from a model that takes a batch of strings; components stay lexical.

    The session is opened once per Python worker, on the model file each worker can read.
    """

    def __init__(self, model_path: str):
        self.model_path = model_path

    def columns(self, line: Column, template: Column) -> tuple[Column, Column]:
        path = self.model_path

        @F.pandas_udf("int")
        def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import onnxruntime

            session = onnxruntime.InferenceSession(path)
            name = session.get_inputs()[0].name
            for lines in batches:
                out = session.run(None, {name: lines.fillna("").to_numpy(dtype=object)})[0]
                yield pd.Series(np.asarray(out).reshape(len(lines), -1).argmax(axis=1).astype("int32"))

        return predicted(line), component(line)


def classifier(backend: str = "lexical", model_path: str = "") -> Classifier:
    """``onnx`` with a model path, else the lexical rules."""
    return OnnxClassifier(model_path) if backend == "onnx" and model_path else LexicalClassifier()


def severity_sql(line: str, unicode: bool = False) -> str:
    """``severity`` in portable SQL, for ASCII text or for any."""
    edge = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"
    pattern = rf"(?:^|{edge})({'|'.join(LEVEL_TOKENS)})(?:$|{edge})" if unicode else rf"\b({'|'.join(LEVEL_TOKENS)})\b"
    token = f"regexp_extract({line}, '{pattern}', 1)"
    names = " ".join(f"WHEN lower({token}) IN ({', '.join(repr(n) for n in names)}) THEN {o}" for o, names in LEVEL_NAMES.items())
    cues = " ".join(f"WHEN {' OR '.join(f'contains(lower({line}), {c!r})' for c in cues)} THEN {o}" for o, cues in CUES)
    return f"CAST(CASE WHEN {token} <> '' THEN CASE {names} ELSE 2 END {cues} ELSE 2 END AS INTEGER)"


def component_sql(line: str) -> str:
    """``component`` in portable SQL."""
    hits = {n: "(" + " + ".join(f"CAST(contains(lower({line}), {c!r}) AS INTEGER)" for c in cues) + ")" for n, cues in COMPONENTS.items()}
    most = f"greatest({', '.join(hits.values())})"
    return f"CASE WHEN {most} = 0 THEN 'other' " + " ".join(f"WHEN {h} = {most} THEN '{n}'" for n, h in hits.items()) + " END"
