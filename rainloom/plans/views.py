"""Verification results as named views of the catalog, created anew in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rainloom.constants import LEAD_RANGES, LEAD_REST, OUTCOME_LABELS

HOURLY, LEAD = "rain_model_accuracy_hourly", "rain_model_accuracy_by_lead"


def external_table(df: DataFrame, name: str, path: str) -> None:
    """A catalog table over files in the shared folder."""
    df.write.option("path", path).saveAsTable(name)


def create_views(
    spark: SparkSession, history: str, truth: str, station: list[str], tie: list[str], as_of: str,
    hourly: str = HOURLY, lead: str = LEAD,
) -> None:
    """Both verification views over the tables ``history`` and ``truth``; existing ones are replaced.

    ``as_of`` is an SQL expression of the time up to which observations are known. The last forecast
    before a target is the largest by time of issue, then by the columns ``tie``; an aggregate, so
    nothing is ranked.
    """
    keys = "".join(f"{s}, " for s in station)
    compared = f"""CAST(f.api_precip_alvo > 0 AS INT) AS api_vai_chover, o.precipitation AS chuva_real_mm, CAST(o.precipitation > 0 AS INT) AS choveu"""
    known = f"JOIN {truth} o ON o.observation_time = f.target_time AND o.observation_time <= {as_of}"
    shown = "ROUND(f.prob_chuva, 3) AS prob_chuva, f.pred_vai_chover"
    outcome = "CASE " + " ".join(
        f"WHEN o.precipitation {'>' if wet else '='} 0 AND f.pred_vai_chover = {said} THEN '{name}'" for (wet, said), name in OUTCOME_LABELS.items()
    ) + " END"
    order = ", ".join(["inferencia_local", *tie])
    spark.sql(f"""
        CREATE OR REPLACE VIEW {hourly} AS
        SELECT {keys}f.target_time, f.inferencia_local, {shown}, f.threshold_usado, f.modelo, f.api_precip_alvo,
               {compared}, {outcome} AS resultado_classificacao
        FROM (SELECT {keys}target_time, last.* FROM (
                SELECT {keys}target_time, MAX_BY(STRUCT(inferencia_local, prob_chuva, pred_vai_chover, threshold_usado, modelo, api_precip_alvo), STRUCT({order})) AS last
                FROM {history} WHERE inferencia_local < target_time GROUP BY {keys}target_time)) f {known}""")
    clock = lambda t: f"hour({t}) * 3600 + minute({t}) * 60 + second({t})"
    target, issued = "f.target_time", "f.inferencia_local"
    seconds = f"(datediff({target}, {issued}) * 86400 + {clock(target)} - ({clock(issued)}))"
    ranges = " ".join(f"WHEN {seconds} <= {hours} * 3600 THEN '{name}'" for hours, name in LEAD_RANGES)
    spark.sql(f"""
        CREATE OR REPLACE VIEW {lead} AS
        SELECT {keys}f.target_time, f.inferencia_local, CAST(CEIL({seconds} / 3600) AS INT) AS antecedencia_h,
               CASE {ranges} ELSE '{LEAD_REST}' END AS faixa_antecedencia, f.modelo, {shown}, f.api_precip_alvo, {compared}
        FROM {history} f {known} WHERE f.inferencia_local < f.target_time""")
