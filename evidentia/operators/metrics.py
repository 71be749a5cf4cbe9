"""How much less than the file a context shows, and how many findings cite what was shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nonblank_lines
from ..session import saved
from .selection import medians


def compression(contexts: DataFrame, files: DataFrame) -> DataFrame:
    """One row. contexts: file, code; files: file, text. Files without lines take no part in ratios. Medians are selected by counting, so nothing holds all ratios."""
    of_file = saved(files.select("file", nonblank_lines(F.col("text")).alias("f")), "file-lines")
    rows = contexts.select("file", nonblank_lines(F.col("code")).alias("s")).join(of_file, "file", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    rows = saved(rows.select("s", "f", F.when(F.col("f") > 0, F.col("s") / F.col("f")).alias("ratio")), "context-lines")
    middle = {c: F.lit(v).cast("double") for c, v in medians(rows, "s", "f", "ratio").items()}
    repo = F.lit(of_file.agg(F.sum("f")).first()[0]).cast("bigint")
    out = rows.agg(F.count("*").alias("contexts"), F.round(F.avg("s"), 1).alias("slice_loc_mean"), F.round(F.avg("ratio"), 4).alias("slice_over_file_mean"), F.avg("s").alias("mean_"))
    return out.select(
        repo.alias("repo_source_loc"), "contexts", middle["s"].cast("bigint").alias("slice_loc_median"), "slice_loc_mean", middle["f"].cast("bigint").alias("file_loc_median"),
        F.round(middle["ratio"], 4).alias("slice_over_file_median"), "slice_over_file_mean", F.round(F.try_divide(F.col("mean_"), F.nullif(repo, F.lit(0))), 6).alias("slice_over_repo_mean"),
    )


def shown(grounding: Column, start: Column, end: Column, code: Column) -> tuple[Column, Column]:
    """First and last line that a judge saw: the whole text if it was raw, else the range and three lines around it."""
    raw = grounding == "raw"
    breaks = F.length(code) - F.length(F.replace(code, F.lit("\n"), F.lit("")))
    return F.when(raw, 1).otherwise(F.greatest(F.lit(1), start - 3)), F.when(raw, start + breaks + 1).otherwise(end + 3)


def grounded(found: DataFrame, contexts: DataFrame) -> DataFrame:
    """findings_checked, grounded and ratio (null if nothing was checked). Findings without a known context don't count."""
    lo, hi = shown(F.col("grounding"), F.col("start_line"), F.col("end_line"), F.col("code"))
    c = contexts.select("context_id", lo.alias("lo_"), hi.alias("hi_"))
    a, b = F.least("start_line", "end_line"), F.greatest("start_line", "end_line")
    rows = found.join(c, "context_id").select(((a <= F.col("hi_")) & (b >= F.col("lo_"))).cast("int").alias("g"))
    counts = rows.agg(F.count("*").alias("findings_checked"), F.coalesce(F.sum("g"), F.lit(0)).alias("grounded"))
    ratio = F.round(F.try_divide(F.col("grounded").cast("double"), F.nullif(F.col("findings_checked"), F.lit(0))), 3)
    return counts.withColumn("ratio", ratio)


def language_counts(files: DataFrame, app: str, language: str) -> DataFrame:
    """The most frequent language of each app and how many files have it; ties go to the first by name."""
    counted = files.groupBy(app, language).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("o"), F.col(language)))
    return counted.groupBy(app).agg(best.alias("b"), F.sum("n").alias("n_files")).select(app, F.col(f"b.{language}").alias(language), (-F.col("b.o")).alias("n"), "n_files")
