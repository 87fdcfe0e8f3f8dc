"""Chunking quality against true chunks, per page and per model."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroscope.idioms import ratio, running
from aeroscope.operators.extraction import segments
from aeroscope.operators.matching import greedy_match

THRESHOLD = 0.5
# Weights of the overall chunk score.
WEIGHTS = {"chunk_count_accuracy": 0.20, "boundary_f1": 0.30, "matched_content_f1": 0.30, "boundary_integrity": 0.20}


def common_pages(truth: DataFrame, models: DataFrame) -> DataFrame:
    """Pages in the truth and in at least one model."""
    return truth.select("page").distinct().intersect(models.select("page").distinct())


def match_chunks(truth: DataFrame, models: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Greedy matches (model, page, i = model chunk, j = true chunk, score) on raw text."""
    left = models.select("model", "page", F.col("chunk").cast("bigint").alias("i"), F.col("text").alias("txt"))
    names = models.select("model", "page").distinct()
    right = truth.select("page", F.col("chunk").cast("bigint").alias("j"), F.col("text").alias("txt")).join(names, "page")
    return greedy_match(left, right.select("model", "page", "j", "txt"), ["model", "page"], threshold)


def page_metrics(truth: DataFrame, models: DataFrame, matches: DataFrame) -> DataFrame:
    """Count error and accuracy, boundary P/R/F1 and mean index error, content P/R/F1 per (model, page)."""
    t = truth.groupBy("page").agg(F.count("*").alias("gt_count"))
    p = models.groupBy("model", "page").agg(F.count("*").alias("count"))
    m = matches.groupBy("model", "page").agg(
        F.count("*").alias("tp"), F.sum("score").alias("score_sum"), F.avg(F.abs(F.col("i") - F.col("j"))).alias("avg_err")
    )
    rows = p.join(t, "page", "left").join(m, ["model", "page"], "left").na.fill(0, ["gt_count", "tp", "score_sum", "avg_err"])
    n, g, tp = F.col("count"), F.col("gt_count"), F.col("tp")
    err = F.abs(n - g)
    prec, rec = ratio(tp, n), ratio(tp, g)
    cp, cr = ratio(F.col("score_sum"), n), ratio(F.col("score_sum"), g)
    return rows.select(
        "model", "page", "count", "gt_count", err.alias("count_error"),
        (1.0 - F.least(F.lit(1.0), err / F.greatest(g, F.lit(1)))).alias("chunk_count_accuracy"),
        prec.alias("boundary_precision"), rec.alias("boundary_recall"),
        ratio(2 * prec * rec, prec + rec).alias("boundary_f1"), F.col("avg_err").alias("boundary_avg_error"),
        cp.alias("matched_content_precision"), cr.alias("matched_content_recall"),
        ratio(2 * cp * cr, cp + cr).alias("matched_content_f1"),
    )


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _ends(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """End offset of each piece in the text joined by single blanks."""
    return running(rows, keys, order, {"upto": F.length("piece") + 1}).select(*keys, order, (F.col("upto") - 1).alias("end"))


def page_integrity(models: DataFrame) -> DataFrame:
    """Share of chunk ends that are sentence ends of the page text (model, page).

    The page text is rebuilt per page from its chunks, the unit the reference also works on.
    """
    pieces = models.withColumn("piece", _squeezed(F.col("text")))
    ends = _ends(pieces.withColumn("ord", F.col("chunk").cast("bigint")).select("model", "page", "ord", "piece"), ["model", "page"], "ord")
    full = pieces.groupBy("model", "page").agg(F.array_sort(F.collect_list(F.struct("chunk", "piece"))).alias("c")).select(
        "model", "page", F.array_join("c.piece", " ").alias("full_text")
    )
    sent = full.select("model", "page", F.posexplode(segments(F.col("full_text"), "sentence")).alias("pos", "piece"))
    s_ends = _ends(sent.withColumn("ord", F.col("pos").cast("bigint")).select("model", "page", "ord", "piece"), ["model", "page"], "ord")
    marks = s_ends.select("model", "page", "end").distinct().withColumn("hit", F.lit(1))
    return (
        ends.join(marks, ["model", "page", "end"], "left").groupBy("model", "page")
        .agg((F.count("hit") / F.count("*")).alias("boundary_integrity"))
    )


def _ends_by_page(rows: DataFrame, keys: list[str]) -> DataFrame:
    """End offset of each piece in the text of all pages joined by single blanks, in (page, chunk) order.

    Sums run inside a page and over one row per page, so a long document is not one task.
    """
    long = F.length("piece") + 1
    before = Window.partitionBy(*keys).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    pages = rows.groupBy(*keys, "page").agg(F.sum(long).alias("n"))
    pages = pages.select(*keys, "page", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    upto = Window.partitionBy(*keys, "page").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("upto", F.sum(long).over(upto))
    return inside.join(pages, [*keys, "page"]).select(*keys, "page", "chunk", (F.col("before") + F.col("upto") - 1).alias("end"))


def document_integrity(models: DataFrame, sentences: DataFrame) -> DataFrame:
    """Share of chunk ends over the whole document that are ends of the given sentences.

    Sentences come by (page, chunk), or by one number, seq.
    """
    if "seq" in sentences.columns:
        sentences = sentences.select(F.floor(F.col("seq") / 4096).alias("page"), F.col("seq").alias("chunk"), "text")
    ends = _ends_by_page(models.select("model", "page", "chunk", _squeezed(F.col("text")).alias("piece")), ["model"])
    s = sentences.select(F.lit(1).alias("one"), "page", "chunk", _squeezed(F.col("text")).alias("piece"))
    marks = _ends_by_page(s, ["one"]).select("end").distinct().withColumn("hit", F.lit(1))
    return ends.join(marks, "end", "left").groupBy("model").agg((F.count("hit") / F.count("*")).alias("boundary_integrity"))


def model_summary(pages: DataFrame, integrity: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Means and population deviations per model and the weighted score."""
    both = ("chunk_count_accuracy", "count_error", "boundary_f1", "matched_content_f1")
    means = ("boundary_precision", "boundary_recall", "boundary_avg_error", "matched_content_precision", "matched_content_recall")
    s = pages.groupBy("model").agg(
        *[F.avg(c).alias(c) for c in (*both, *means)], *[F.stddev_pop(c).alias(f"{c}_std") for c in both]
    )
    out = s.join(integrity, "model", "left").na.fill(1.0, ["boundary_integrity"])
    return out.withColumn("overall", sum(F.col(n) * w for n, w in weights.items()))
