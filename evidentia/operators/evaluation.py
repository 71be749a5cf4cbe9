"""Findings against ground truth: interval match, novelty, the pick for each label, rates and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.predicates import basename, control_classes
from ..functions.text import rate
from ..session import saved

#: Lines before and after a label.
WINDOW = 20


def interval_matches(labels: DataFrame, found: DataFrame, keys: list[str], window: int = WINDOW, *, start: str = "start_line", end: str = "end_line") -> DataFrame:
    """Pairs of a label and a finding of the same keys whose start or end lies in the label's window.

    labels: keys, label_start, label_end. A finding that encloses the window doesn't match. Windows are cut into bins of the window's
    size, so the join is on equal keys and bin, and grows with the matches instead of with all pairs of a file.
    """
    size = 2 * window + 1
    lo, hi = F.col("label_start") - window, F.col("label_end") + window
    binned = labels.withColumns({"lo_": lo, "hi_": hi}).withColumn("bin_", F.explode(F.sequence(F.floor(F.col("lo_") / size), F.floor(F.col("hi_") / size))))
    ends = F.array_distinct(F.array(F.floor(F.col(start) / size), F.floor(F.col(end) / size)))
    inside = [F.col(c).between(F.col("lo_"), F.col("hi_")) for c in (start, end)]
    bins = [F.floor(F.col(c) / size) for c in (start, end)]
    # A finding with both ends inside, in two bins, counts in its start's bin.
    once = F.when(inside[0], F.col("bin_") == bins[0]).otherwise(inside[1] & (F.col("bin_") == bins[1]))
    return binned.join(found.withColumn("bin_", F.explode(ends)), [*keys, "bin_"]).filter(once).drop("bin_", "lo_", "hi_")


def with_novelty(found: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """found with novel: whether the baseline has no row with its keys. A mark, not a filter."""
    known = baseline.select(*keys).distinct().withColumn("known_", F.lit(True))
    return found.join(known, keys, "left").withColumn("novel", F.col("known_").isNull()).drop("known_")


def scored(matches: DataFrame, label: str, position: str, *carry: str) -> DataFrame:
    """One row for each label with matches: detected (a novel match), detected_raw (any), and the match that stands for it.

    matches: label, position, novel, class_ok. Among novel matches the first of the right class, else the last; without a novel
    one the first match.
    """
    first_ok = F.min(F.when(F.col("novel") & F.col("class_ok"), F.col(position)))
    last_novel = F.max(F.when(F.col("novel"), F.col(position)))
    picks = matches.groupBy(label).agg(F.coalesce(first_ok, last_novel, F.min(position)).alias(position), F.max("novel").alias("detected"))
    return picks.join(matches.select(label, position, "class_ok", *carry), [label, position]).withColumn("detected_raw", F.lit(True))


def score_mutations(labels: DataFrame, found: DataFrame, baseline: DataFrame, window: int = WINDOW) -> DataFrame:
    """All runs in one job: labels (run_id and the label's columns), findings (run_id, position and more), baseline (app, file, start_line).

    A result for each label: detected, detected_raw, matched_title, matched_line, matched_control_ok, n_findings. Files are the same if their base names are.
    """
    claims = control_classes("vulnerability_type", "cwe", "title", "description", "data_flow_summary")
    f = found.join(labels.select("run_id", "app").distinct(), "run_id").withColumn("name", basename(F.col("file"))).withColumn("claims", claims)
    f = with_novelty(f, baseline.select("app", basename(F.col("file")).alias("name"), "start_line"), ["app", "name", "start_line"])
    ground = labels.withColumn("name", basename(F.col("file"))).withColumnsRenamed({"start_line": "label_start", "end_line": "label_end"})
    ground = ground.select("run_id", "name", "label_start", "label_end", "control_class")
    matches = interval_matches(ground, f.select("run_id", "name", "start_line", "end_line", "position", "novel", "claims", "title"), ["run_id", "name"], window)
    matches = matches.withColumn("class_ok", F.array_contains("claims", F.col("control_class")))
    picked = scored(matches, "run_id", "position", "title", "start_line")
    number = found.groupBy("run_id").agg(F.count("*").alias("n_findings"))
    out = labels.join(picked.select("run_id", "detected", "detected_raw", F.col("title").alias("matched_title"), F.col("start_line").alias("matched_line"), F.col("class_ok").alias("matched_control_ok")), "run_id", "left")
    out = out.join(number, "run_id", "left")
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("detected", "detected_raw", "matched_control_ok")}
    return out.withColumns({**flags, "n_findings": F.coalesce("n_findings", F.lit(0)), "matched_title": F.coalesce("matched_title", F.lit("")), "matched_line": F.coalesce("matched_line", F.lit(0))})


def precision_recall_f1(tp: Column, fp: Column, fn: Column, digits: int = 3, of_rounded: bool = False) -> dict[str, Column]:
    """of_rounded: F1 from the rounded rates, as pooled figures have it."""
    p, r = (rate(tp, tp + other, digits if of_rounded else 15) for other in (fp, fn))
    return {"precision": F.round(p, digits), "recall": F.round(r, digits), "f1": F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), digits)}


def summary(results: DataFrame, baseline_fp: DataFrame) -> DataFrame:
    """A row for each app: counts and rates. Every stray finding of every run counts as a false positive, and so does the baseline."""
    hit = F.col("detected").cast("int")
    stray = F.greatest(F.col("n_findings") - hit, F.lit(0))
    per = results.groupBy("app").agg(F.count("*").alias("n_mutations"), F.sum(hit).alias("tp"), F.sum(F.col("detected_raw").cast("int")).alias("raw"), F.sum(stray).alias("stray"))
    per = per.join(baseline_fp.select("app", "baseline_fp"), "app", "left").withColumn("baseline_fp", F.coalesce("baseline_fp", F.lit(0)))
    per = per.withColumns({"fn": F.col("n_mutations") - F.col("tp"), "fp": F.col("baseline_fp") + F.col("stray"), "recall_raw": rate(F.col("raw"), F.col("n_mutations"))})
    per = per.withColumns(precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn")))
    return per.select("app", "n_mutations", "baseline_fp", "tp", "fp", "fn", "precision", "recall", "recall_raw", "f1")


def recall_by(results: DataFrame, *buckets: str) -> DataFrame:
    """Recall for each value of each bucket column, in one pass: bucket, value, tp, fn, recall."""
    sets = results.groupingSets([[b] for b in buckets], *buckets) if len(buckets) > 1 else results.groupBy(*buckets)
    agg = sets.agg(F.sum(F.col("detected").cast("int")).alias("tp"), F.count("*").alias("n"), *([F.grouping_id().alias("g")] if len(buckets) > 1 else [F.lit(0).alias("g")]))
    # A grouping id has a bit for each column that is rolled up, the first column highest.
    ids = {((1 << len(buckets)) - 1) ^ (1 << (len(buckets) - 1 - k)): b for k, b in enumerate(buckets)} if len(buckets) > 1 else {0: buckets[0]}
    name, value = F.lit(None), F.lit(None).cast("string")
    for g, b in ids.items():
        name, value = F.when(F.col("g") == g, b).otherwise(name), F.when(F.col("g") == g, F.col(b).cast("string")).otherwise(value)
    out = agg.select(name.alias("bucket"), value.alias("value"), "tp", (F.col("n") - F.col("tp")).alias("fn"))
    return out.withColumn("recall", rate(F.col("tp"), F.col("tp") + F.col("fn")))


def pooled(apps: DataFrame, *means: str) -> DataFrame:
    """Rates over the summed counts of all apps; recall_raw from the apps' rounded ones; plain means of the given columns, nulls left out."""
    total = apps.agg(
        F.count("*").alias("apps"), *[F.sum(c).alias(c) for c in ("n_mutations", "baseline_fp", "tp", "fp", "fn")],
        F.sum(F.round(F.col("recall_raw") * F.col("n_mutations"))).alias("raw"), *[F.round(F.avg(m), 2).alias(m) for m in means],
    )
    total = total.withColumns({**precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"), of_rounded=True), "recall_raw": rate(F.col("raw"), F.col("n_mutations"))})
    return total.drop("raw")


def heldout_pick(matches: DataFrame, label: str, position: str) -> DataFrame:
    """The match of each label: the first of the right class, else the first. matches: label, position, class_ok."""
    w = W.partitionBy(label).orderBy(F.desc("class_ok"), position)
    return matches.withColumn("k_", F.row_number().over(w)).filter("k_ = 1").drop("k_")


def unmatched(found: DataFrame, labels: DataFrame, keys: list[str], window: int = WINDOW, *, start: str = "start_line") -> DataFrame:
    """Findings whose start lies near no label of the same keys. labels: keys, label_line, and label_last if a label has several lines.

    Joined on equal keys and a bin of the window's size, so that a file with many of both isn't compared in pairs.
    """
    size = 2 * window + 1
    last = "label_last" if "label_last" in labels.columns else "label_line"
    near = labels.select(*keys, (F.col("label_line") - window).alias("lo_"), (F.col(last) + window).alias("hi_"))
    near = near.withColumn("bin_", F.explode(F.sequence(F.floor(F.col("lo_") / size), F.floor(F.col("hi_") / size))))
    binned = found.withColumn("bin_", F.floor(F.col(start) / size))
    condition = (binned["bin_"] == near["bin_"]) & F.col(start).between(F.col("lo_"), F.col("hi_"))
    for k in keys:
        condition = condition & (binned[k] == near[k])
    return binned.join(near, condition, "left_anti").drop("bin_")


def heldout_summary(results: DataFrame) -> DataFrame:
    """results: detected, class_ok, control_class for each label."""
    hit, ok = F.sum(F.col("detected").cast("int")), F.sum((F.col("detected") & F.col("class_ok")).cast("int"))
    return results.agg(F.count("*").alias("n_labels"), hit.alias("n_detected"), rate(hit, F.count("*")).alias("recall"), rate(ok, hit).alias("class_ok_rate"))


def benchmark(rows: DataFrame, bucket: str, detector: str, names: list[str]) -> DataFrame:
    """Recall of each detector for each bucket, one column a detector. rows: bucket, detector, tp, fn."""
    return rows.groupBy(bucket).agg(*[rate(F.sum(F.when(F.col(detector) == n, F.col("tp"))), F.sum(F.when(F.col(detector) == n, F.col("tp") + F.col("fn")))).alias(n) for n in names])


def _buckets(results: DataFrame, column: str, name: str) -> DataFrame:
    """app and, in order of the column's values, a map from each to tp, fn and recall."""
    hit = F.sum(F.col("detected").cast("int"))
    by = results.groupBy("app", column).agg(hit.alias("tp"), (F.count("*") - hit).alias("fn"))
    entry = F.struct(F.col(column).alias("key"), F.struct("tp", "fn", rate(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall")).alias("value"))
    return by.groupBy("app").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name))


def evaluate(labels: DataFrame, found: DataFrame, baseline: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """A whole evaluation, whatever detector made the findings: a result for each label, and a summary for each app with its roll-ups.

    labels, found and baseline as in score_mutations(); every row of baseline is a finding on an unmutated program. The results are written, as three roll-ups read them.
    """
    results = saved(score_mutations(labels, found, baseline, window), "results")
    out = summary(results, baseline.groupBy("app").agg(F.count("*").alias("baseline_fp")))
    return results, out.join(_buckets(results, "operator", "by_operator"), "app").join(_buckets(results, "control_class", "by_control_class"), "app")


def score_heldout(labels: DataFrame, found: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Findings against labels made elsewhere: a result for each label, and a summary for each app, with findings near no label and recall by class.

    labels: app, label_id, file, start_line, end_line, control_class. found: app, position, and the columns of findings.
    """
    claims = control_classes("vulnerability_type", "cwe", "title", "description", "data_flow_summary")
    f = found.withColumn("name", basename(F.col("file"))).withColumn("claims", claims)
    ground = labels.withColumn("name", basename(F.col("file"))).withColumnsRenamed({"start_line": "label_start", "end_line": "label_end"})
    matches = interval_matches(ground.select("app", "label_id", "name", "label_start", "label_end", "control_class"), f.select("app", "name", "start_line", "end_line", "position", "claims", "title"), ["app", "name"], window)
    picked = heldout_pick(matches.withColumn("class_ok", F.array_contains("claims", F.col("control_class"))), "label_id", "position")
    picked = picked.select("label_id", F.lit(True).alias("detected"), "class_ok", F.col("title").alias("matched_title"), F.col("start_line").alias("matched_line"))
    results = saved(labels.join(picked, "label_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("detected", "class_ok")}), "results")
    spans = ground.select("app", "name", F.col("label_start").alias("label_line"), F.col("label_end").alias("label_last"))
    stray = unmatched(f.select("app", "name", "start_line"), spans, ["app", "name"], window).groupBy("app").agg(F.count("*").alias("n_findings_unmatched"))
    hit, ok = F.sum(F.col("detected").cast("int")), F.sum((F.col("detected") & F.col("class_ok")).cast("int"))
    out = results.groupBy("app").agg(F.count("*").alias("n_labels"), hit.alias("n_detected"), rate(hit, F.count("*")).alias("recall"), rate(ok, hit).alias("class_ok_rate"))
    out = out.join(found.groupBy("app").agg(F.count("*").alias("n_findings")), "app", "left").join(stray, "app", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_findings", "n_findings_unmatched")})
    return results, out.join(_buckets(results, "control_class", "by_control_class"), "app")
