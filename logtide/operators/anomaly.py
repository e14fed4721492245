"""Anomaly rules as one array column of reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import Settings


def reasons(severity: Column, is_new: Column, is_rare: Column, rate_z: Column, settings: Settings = Settings()) -> Column:
    """Reasons in fixed order; the line is an anomaly if there is any.

    ``is_rare``: the template had at most ``rare_template_threshold`` lines up to this one.
    """
    return F.array_compact(
        F.array(
            F.when(severity >= 5, F.lit("critical_severity")),
            F.when(is_new & (severity >= 3), F.lit("new_template")),
            F.when(is_rare & (severity >= 4), F.lit("rare_error")),
            F.when(rate_z >= settings.rate_spike_z, F.lit("rate_spike")),
        )
    )
