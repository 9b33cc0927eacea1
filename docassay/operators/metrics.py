"""Evaluation: confusion counts, ranking quality, sweeps, splits, standardised features."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docassay.functions.numbers import ratio


def confusion(actual: Column, predicted: Column) -> dict[str, Column]:
    return {"tp": F.count_if(actual & predicted), "fp": F.count_if(~actual & predicted), "tn": F.count_if(~actual & ~predicted), "fn": F.count_if(actual & ~predicted)}


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Accuracy, precision, recall and F1; 0 where a denominator is."""
    return {"accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}


def binary_metrics(scored: DataFrame, score: str, threshold: int = 25, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and rates over rows labelled fake or normal, as one aggregate."""
    labelled = scored.where(F.col("label").isin("fake", "normal"))
    counts = confusion(F.col("label") == "fake", F.col(score) >= threshold)
    out = labelled.groupBy(*by).agg(F.count("*").alias("sample_count"), *(v.alias(k) for k, v in counts.items()))
    return out.select(*by, "sample_count", *counts, *(v.alias(k) for k, v in rates(*(F.col(k) for k in ("tp", "fp", "tn", "fn"))).items()))


def dual_scope(scored: DataFrame, threshold: int = 25) -> DataFrame:
    """The full score and the marker-free one, in one pass over the records."""
    free = "marker_free_risk_score" if "marker_free_risk_score" in scored.columns else "combined_risk_score"
    pair = F.array(F.struct(F.lit("full_labeled_set").alias("scope"), F.col("combined_risk_score").alias("score")), F.struct(F.lit("marker_free_counterfactual").alias("scope"), F.col(free).alias("score")))
    long = scored.select("label", F.explode(pair).alias("x")).select("label", "x.scope", "x.score")
    return binary_metrics(long, "score", threshold, ("scope",))


#: Ranges of a score that are summed up side by side.
RANGES = 1024


def with_sums_before(by: DataFrame, value: str, *columns: str, descending: bool = False) -> DataFrame:
    """Rows of distinct values with before_<column>: the sum over all smaller (or greater) values. Values are dealt to RANGES
    equal ranges; a task orders one range, and the ranges' totals, few rows, give the offsets."""
    ends = by.agg(F.min(value).alias("low_"), F.max(value).alias("high_"))
    place = F.coalesce(F.try_divide((F.col(value) - F.col("low_")) * (RANGES - 1), F.col("high_") - F.col("low_")), F.lit(0))
    dealt = by.join(F.broadcast(ends)).withColumn("range_", F.floor(place).cast("int")).drop("low_", "high_")  # one row
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    across = Window.orderBy(order("range_")).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("range_").agg(*(F.sum(c).alias(c) for c in columns)).select("range_", *(F.coalesce(F.sum(c).over(across), F.lit(0)).alias(f"offset_{c}") for c in columns))
    inside = Window.partitionBy("range_").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(F.broadcast(totals), "range_")  # RANGES rows
    return joined.select(*by.columns, *((F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"offset_{c}")).alias(f"before_{c}") for c in columns))


def roc_auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Area under the curve by mid-ranks, from counts by distinct score: rows are summed up before any ordering."""
    by = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    placed = with_sums_before(by, "s", "n")
    return placed.select("p", "n", (F.col("p") * (F.col("before_n") + F.col("n") / 2)).alias("won")).agg(F.bround(F.try_divide(F.sum("won"), (F.sum("p") * F.sum("n")).cast("double")), 6).alias("auc"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))


def average_precision(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Mean precision at the recall steps of distinct scores."""
    by = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(positive).alias("p"), F.count("*").alias("n"))
    placed = with_sums_before(by, "s", "p", "n", descending=True)
    precision = (F.col("before_p") + F.col("p")) / (F.col("before_n") + F.col("n"))
    return placed.select("p", (F.col("p") * precision).alias("x")).agg(F.bround(F.try_divide(F.sum("x"), F.sum("p").cast("double")), 6).alias("average_precision"))


def threshold_sweep(df: DataFrame, score: str, positive: Column, steps: int = 19) -> DataFrame:
    """F1 at 0.05, 0.10 ... of a score in 0..1; best is the first maximum. Each row adds to its bin, bins are summed up."""
    bin_ = F.least(F.lit(steps), F.greatest(F.lit(0), F.floor(F.col(score) * (steps + 1) + 1e-9))).cast("int")
    by = df.groupBy(bin_.alias("b")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    grid = df.sparkSession.range(1, steps + 1).select(F.col("id").cast("int").alias("k"))
    joined = F.broadcast(grid).join(by)  # steps rows times as many bins
    counts = joined.groupBy("k").agg(F.sum(F.when(F.col("b") >= F.col("k"), F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("b") >= F.col("k"), F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(F.col("b") < F.col("k"), F.col("p")).otherwise(0)).alias("fn"))
    scored = counts.select(F.bround(F.col("k") / (steps + 1.0), 2).alias("threshold"), "tp", "fp", "fn", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))
    best = scored.agg(F.max(F.struct("f1", (-F.col("threshold")).alias("t")))["t"].alias("t")).select((-F.col("t")).alias("best"))
    return scored.join(F.broadcast(best)).select("threshold", "tp", "fp", "fn", "f1", (F.col("threshold") == F.col("best")).alias("is_best"))


def multiclass(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Support, precision, recall and F1 of each class."""
    sides = df.select(F.explode(F.array(F.struct(F.col(label).alias("name"), F.lit(1).alias("own"), F.lit(0).alias("given"), (F.col(label) == F.col(predicted)).cast("int").alias("hit")), F.struct(F.col(predicted).alias("name"), F.lit(0).alias("own"), F.lit(1).alias("given"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    by = sides.groupBy(F.col("name").alias("class")).agg(F.sum("own").alias("support"), F.sum("given").alias("predicted"), F.sum("hit").alias("hits"))
    return by.select("class", "support", "predicted", "hits", ratio(F.col("hits"), F.col("predicted")).alias("precision"), ratio(F.col("hits"), F.col("support")).alias("recall"), ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes given by x0, y0, x1, y1."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def localisation(df: DataFrame, group: str) -> DataFrame:
    """Detection counts, mean IoU of true detections and recall at IoU 0.5, in all and by group."""
    c = F.col
    counts = confusion(c("has_seal"), c("detected"))
    out = df.groupingSets([[], [group]], group).agg(F.count("*").alias("samples"), *(v.alias(k) for k, v in counts.items()), F.bround(F.avg(F.when(c("has_seal") & c("detected"), c("iou"))), 4).alias("mean_iou"), ratio(F.count_if(c("has_seal") & c("detected") & (c("iou") >= 0.5)), F.count_if("has_seal"), 4).alias("recall_iou_50"))
    return out.withColumn(group, F.coalesce(c(group).cast("string"), F.lit("all")))


def hash_order(key: str) -> Column:
    """What rows are shuffled by: the digest of a key, which every engine computes alike."""
    return F.md5(F.col(key).cast("string").cast("binary"))


def first_by_hash(rows: DataFrame, key: str, group: str, wanted: Column) -> DataFrame:
    """Rows with chosen: whether a row is among the first of its group in hash order, as many as wanted, a column of the
    group's count n. Counts by group and the digest's first letters say in which slice the last one is; only that slice
    is ordered, so no task holds a group."""
    sliced = rows.withColumn("hash_", hash_order(key)).withColumn("slice_", F.left("hash_", F.lit(3)))
    upto = Window.partitionBy(group).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sliced.groupBy(group, "slice_").agg(F.count("*").alias("here_"))  # 4,096 rows a group
    whole = sizes.select(group, "slice_", "here_", F.coalesce(F.sum("here_").over(upto), F.lit(0)).alias("before_"), F.sum("here_").over(Window.partitionBy(group)).alias("n"))
    cut = whole.withColumn("wanted_", wanted)
    joined = sliced.join(cut, [group, "slice_"])
    rank = F.row_number().over(Window.partitionBy(group, "slice_").orderBy("hash_", key))
    sure, never = F.col("before_") + F.col("here_") <= F.col("wanted_"), F.col("before_") >= F.col("wanted_")
    chosen = F.when(sure, True).when(never, False).otherwise(F.col("before_") + rank <= F.col("wanted_"))
    return joined.select(*rows.columns, chosen.alias("chosen"))


def split_by_document(df: DataFrame, key: str, group: str, share: float = 0.2) -> DataFrame:
    """Each group's documents in hash order, the first share of them (one at least, all but one at most) for validation."""
    n = F.col("n")
    wanted = F.when(n > 1, F.greatest(F.lit(1), F.least(n - 1, F.bround(n * share).cast("bigint")))).otherwise(0)
    chosen = first_by_hash(df.select(key, group).distinct(), key, group, wanted)
    return chosen.select(key, group, F.when(F.col("chosen"), "validation").otherwise("train").alias("split"))


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.25) -> DataFrame:
    """Each label's rows in hash order, the first share of them (one at least, where there are two) for validation."""
    n = F.col("n")
    wanted = F.when(n > 1, F.greatest(F.lit(1), F.bround(n * share).cast("bigint"))).otherwise(0)
    chosen = first_by_hash(df, key, label, wanted)
    return chosen.withColumn("split", F.when(F.col("chosen"), "validation").otherwise("train")).drop("chosen")


def standardise(df: DataFrame, columns: list[str], fitted_on: Column) -> DataFrame:
    """Columns less their mean over their population deviation (0 counts as 1), both of the fitted rows."""
    stats = df.where(fitted_on).agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("d", F.stddev_pop))))
    joined = df.join(F.broadcast(stats))  # one row
    return joined.select(*[c for c in df.columns if c not in columns], *(((F.col(c) - F.col(f"m_{c}")) / F.coalesce(F.nullif(F.col(f"d_{c}"), F.lit(0.0)), F.lit(1.0))).alias(c) for c in columns))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Inverse frequency over its mean across classes."""
    by = df.groupBy(label).agg(F.count("*").alias("n"))
    return by.select(label, "n", F.bround((1.0 / F.col("n")) / F.avg(1.0 / F.col("n")).over(Window.partitionBy()), 6).alias("weight"))


def data_warnings(df: DataFrame, split: str = "split") -> DataFrame:
    """What is too little to train on."""
    fake, normal = F.count_if(F.col("label") == "fake"), F.count_if(F.col("label") == "normal")
    held = F.count_if((F.col("label") == "fake") & (F.col(split) == "validation"))
    share = F.try_divide(F.greatest(fake, normal).cast("double"), F.least(fake, normal).cast("double"))
    return df.agg(F.array_compact(F.array(F.when(fake < 20, F.lit("few_fake_samples")), F.when(held < 5, F.lit("few_validation_fakes")), F.when(F.coalesce(share, F.lit(1e9)) > 10, F.lit("class_imbalance")))).alias("warnings"), fake.alias("fake"), normal.alias("normal"))


def sample_weights(df: DataFrame, label: str, alpha: float) -> DataFrame:
    """Every row's weight in sampling: its class's count to the power of -alpha."""
    by = df.groupBy(label).agg(F.count("*").alias("n"))
    return df.join(F.broadcast(by), label).withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(-alpha))).drop("n")  # one row a class


def macro(per_class: DataFrame) -> DataFrame:
    """Means over the classes that have support, from the rows of multiclass."""
    own = per_class.where("support > 0")
    return own.agg(F.count("*").alias("classes"), F.bround(F.avg("recall"), 6).alias("macro_recall"), F.bround(F.avg("f1"), 6).alias("macro_f1"))


def confusion_table(df: DataFrame, label: str, predicted: str, classes: list[str]) -> DataFrame:
    """One row a label, one column a prediction."""
    return df.groupBy(F.col(label).alias("label")).pivot(predicted, classes).count().fillna(0)


def provenance(scored: DataFrame) -> DataFrame:
    """sample_count, dataset_version and scoring_version (the commonest; ties by name) of the rows labelled fake or normal.

    The version ends with a digest over the sorted identities of all labelled rows. A digest reads its text in order, so
    this one step is a single task's: it takes sorted rows one batch at a time and keeps nothing but the digest's state.
    """
    labelled = scored.where(F.col("label").isin("fake", "normal"))
    identity = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("document_id", "label", "doc_type", "path")))
    lines = labelled.select("document_id", identity.alias("line")).coalesce(1).sortWithinPartitions("document_id", "line").select("line")

    def digest(batches):
        state, n = hashlib.sha256(), 0
        for batch in batches:
            for line in batch.column("line").to_pylist():
                state.update(("\n" if n else "").encode() + line.encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"sample_count": pa.array([n], pa.int64()), "dataset_version": [f"labeled-{n}-{state.hexdigest()[:12]}"]})

    made = lines.mapInArrow(digest, "sample_count bigint, dataset_version string")
    versions = labelled.where("scoring_version <> ''").groupBy("scoring_version").agg(F.count("*").alias("n"))
    first = versions.agg(F.coalesce(F.min_by("scoring_version", F.struct(-F.col("n"), "scoring_version")), F.lit("unknown")).alias("scoring_version"))
    return made.join(F.broadcast(first))  # one row each


# How a made fake's file is named, and which kinds of tampering are those of a PDF's layers.
TAMPER_FILE = r"synthetic_fake_\d+_([^/]+)\.pdf$"
PDF_TAMPERING = ("local_cover_overlay", "screenshot_to_pdf", "page_splice", "text_layer_mismatch", "font_mismatch", "noise_patch", "signature_paste")
SEAL_TAMPERING = ("stamp_paste",)
PANELS = ("pdf_tamper", "fake_seal", "ps_invoice", "credit_report", "similar_image")
LEAST_SAMPLES = 20


def tamper_kind(path: Column) -> Column:
    """The kind of tampering in the name of a made fake, else nothing."""
    return F.regexp_extract(F.coalesce(path, F.lit("")), TAMPER_FILE, 1)


def acceptance_panels(scored: DataFrame, score: str = "marker_free_risk_score", threshold: int = 25) -> DataFrame:
    """key, status and metrics of each panel: its fakes against its normal documents, in one pass over the rows."""
    fake, normal, kind, of = F.col("label") == "fake", F.col("label") == "normal", F.col("kind_"), lambda t: F.col("doc_type") == t
    member = {"pdf_tamper": normal | fake & kind.isin(*PDF_TAMPERING), "fake_seal": normal | fake & kind.isin(*SEAL_TAMPERING), "ps_invoice": of("invoice"), "credit_report": of("credit_report")}
    rows = scored.where(fake | normal).withColumn("kind_", tamper_kind(F.col("path")))
    panels = F.array_compact(F.array(*(F.when(inside, F.lit(key)) for key, inside in member.items())))
    counted = binary_metrics(rows.withColumn("key", F.explode(panels)), score, threshold, ("key",))
    known = scored.sparkSession.createDataFrame([(k, i) for i, k in enumerate(PANELS)], "key string, place int")
    joined = known.join(counted, "key", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("sample_count", "tp", "fp", "tn", "fn")})
    fakes, normals = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    status = F.when((fakes == 0) | (normals == 0), "unavailable").when(F.least(fakes, normals) < LEAST_SAMPLES, "insufficient").otherwise("diagnostic")
    shown = [F.when(F.col("status") != "unavailable", F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1")]
    return joined.withColumn("status", status).select("place", "key", "status", "sample_count", "tp", "fp", "tn", "fn", *shown)
