"""The batch pipeline: raw lines to judged lines, incident clusters and alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import masking
from ..functions.classify import classifier
from ..operators import alerts, anomaly, clustering, features, templates
from ..scratch import materialise
from ..settings import Settings


@dataclass(frozen=True)
class Result:
    """Tables of one run; alerts are routed when read."""

    lines: DataFrame
    clusters: DataFrame
    alerts: DataFrame


def masked(lines: DataFrame) -> DataFrame:
    return lines.withColumn("masked", masking.mask(F.col("line")))


def explained(rated: DataFrame, settings: Settings = Settings(), seen: DataFrame | None = None) -> DataFrame:
    """Rated lines with is_new, is_rare, reasons and is_anomaly.

    ``seen`` are the same lines before they were rated: where rated lines are not written, templates' first lines are found
    there, so that lines are rated once."""
    place = F.struct("ts", "id")
    early = templates.first_rows(rated if seen is None else seen, settings.rare_template_threshold)
    out = rated.join(early, "template_id").withColumns({"is_new": place == F.col("first"), "is_rare": place <= F.col("upto")}).drop("first", "upto")
    why = anomaly.reasons(F.col("severity"), F.col("is_new"), F.col("is_rare"), F.col("rate_z"), settings)
    return out.withColumn("reasons", why).withColumn("is_anomaly", F.size("reasons") > 0)


def judged(lines: DataFrame, settings: Settings = Settings(), with_variables: bool = False, with_text: bool = True) -> DataFrame:
    """Lines (``id, line, source, ts``) with template, severity, component, rate_z, reasons and is_anomaly.

    Masked and classed lines are written once: ids that a source makes up stay what they are, and mining,
    rates and rules read them without masking anew.  Without ``with_text`` no ``line`` and ``masked`` are carried on: they
    are most of what is written, shuffled and sorted per line.
    """
    severity, component = classifier(settings.classifier_backend, settings.onnx_model_path).columns(F.col("line"), F.lit(None).cast("string"))
    classed = masked(lines).withColumns({"severity": severity, "component": component})
    lines = materialise(classed if with_text or with_variables else classed.drop("line"), "masked")
    with_template = templates.with_templates(lines, materialise(templates.mine(lines, settings), "templates"))
    if not with_text:
        with_template = with_template.drop("masked")
    out = explained(materialise(features.rate_z(with_template, "template_id", settings), "rated"), settings)
    if with_variables:
        out = out.withColumn("variables", masking.extract_variables(F.col("line")))
    return out if with_text else out.drop("line")


def run(lines: DataFrame, settings: Settings = Settings(), with_variables: bool = False, with_text: bool = True) -> Result:
    """The whole chain; ``lines`` of the result also carry cluster_id and new_incident.

    Judged lines are written once, as every later table reads them; so is the small assignment
    of templates to clusters.  A line's cluster and flag follow from its template and its place, so
    nothing is joined on line ids.
    """
    found = materialise(judged(lines, settings, with_variables, with_text), "judged")
    is_gated = clustering.gate(F.col("severity"), F.col("is_new"), F.col("reasons"))
    gated = found.where(is_gated)
    assigned = materialise(clustering.assign(gated, settings), "assigned")
    since = materialise(clustering.promotions(gated, assigned, settings), "promotions")
    by_template = assigned.join(since, "cluster_id", "left")
    full = clustering.flagged(found.join(by_template, "template_id", "left"), is_gated, settings)
    return Result(full, clustering.clusters(gated, assigned, settings), alerts.alerts(full, settings))


def projected(lines: DataFrame, *more: str) -> DataFrame:
    """The persisted projection of parsed lines."""
    return lines.select("id", "source", "ts", "template", "template_id", "severity", "component", "cluster_id", "is_anomaly", F.col("reasons").alias("anomaly_reasons"), *more)
