"""Where results go. All writers write in parallel; none gathers rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.operators.moderation import display_rows
from textwarden.operators.report import report_document
from textwarden.operators.validate import with_status


def write_results_csv(moderated: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The result table as CSV with a header, texts shortened for reading."""
    write_csv(display_rows(moderated), path, mode)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """All columns as CSV; nested ones as JSON text. Quotes are doubled, as readers expect."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    flat = df.withColumns({name: F.to_json(name) for name in nested}) if nested else df
    flat.write.mode(mode).options(header=True, escape='"').csv(path)


def write_moderated(moderated: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The moderated corpus as Parquet, one folder per verdict so that readers can skip folders."""
    moderated.write.mode(mode).partitionBy("verdict").parquet(path)


def write_requests(checked: DataFrame, path: str, raw: str, mode: str = "errorifexists") -> None:
    """Checked requests in one pass over them: accepted ones under ``status=accepted``, the dead letters with
    their reasons and raw form under ``status=rejected``. Accepted rows do not keep ``raw``."""
    kept = F.when(F.col("status") == "rejected", F.col(raw))
    with_status(checked).withColumn(raw, kept).write.mode(mode).partitionBy("status").parquet(path)


def write_report(
    metrics: DataFrame,
    detail: DataFrame,
    path: str,
    model: str,
    threshold: float,
    mode: str = "errorifexists",
) -> None:
    """A report as JSON: ``metrics`` (one nested document), ``per_language``, ``overall``, ``detail``."""
    report_document(metrics, model, threshold).write.mode(mode).json(f"{path}/metrics")
    metrics.where(F.col("lang") != "overall").write.mode(mode).json(f"{path}/per_language")
    metrics.where(F.col("lang") == "overall").write.mode(mode).json(f"{path}/overall")
    detail.write.mode(mode).json(f"{path}/detail")
