"""All knobs in one immutable object, passed explicitly; ``from_env`` overrides them by name."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from .errors import ConfigError


@dataclass(frozen=True)
class Settings:
    embed_dim: int = 64
    classifier_backend: str = "lexical"
    onnx_model_path: str = ""
    kafka_brokers: str = "localhost:9092"
    topic: str = "logs.raw"
    anomaly_topic: str = "logs.anomalies"
    partitions: int = 8
    storage_format: str = "parquet"
    storage_path: str = "logtide-store"
    cluster_similarity: float = 0.6
    min_cluster_size: int = 3
    new_incident_seconds: float = 3600.0
    rare_template_threshold: int = 3
    rate_spike_z: float = 3.0
    alert_min_severity: int = 4
    cooldown_seconds: float = 300.0
    window_seconds: int = 60
    ewma_alpha: float = 0.3
    prefix_depth: int = 4
    template_similarity: float = 0.4
    max_children: int = 100
    batch_size: int = 500
    throughput_window: int = 20_000
    anomaly_cap: int = 5_000
    alert_cap: int = 2_000
    state_idle_seconds: int = 0

    def __post_init__(self):
        if self.window_seconds < 1 or self.partitions < 1 or self.prefix_depth < 2:
            raise ConfigError("window_seconds and partitions are at least 1, prefix_depth at least 2")

    @classmethod
    def from_env(cls, environ=None) -> Settings:
        """Defaults overridden by ``LOGTIDE_<FIELD>`` variables."""
        environ = os.environ if environ is None else environ
        kinds = {"int": int, "float": float, "str": str}
        found = {f.name: (environ[name], kinds[f.type]) for f in fields(cls) if (name := f"LOGTIDE_{f.name.upper()}") in environ}
        try:
            return cls(**{k: kind(v) for k, (v, kind) in found.items()})
        except ValueError as e:
            raise ConfigError(str(e)) from e
