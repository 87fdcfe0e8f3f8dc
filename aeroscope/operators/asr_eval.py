"""Transcript scores: word error rate and its relatives, per sample and per model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroscope.functions.fuzzy import word_edits
from aeroscope.functions.normalize import normalize
from aeroscope.idioms import join_nulls, once_per_value, salted
from aeroscope.session import cut


def words(text: Column, spoken_form: bool = True) -> Column:
    """Words to compare; null or empty text gives none."""
    t = F.coalesce(text, F.lit(""))
    t = F.lower(normalize(t) if spoken_form else t)
    return F.filter(F.split(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")), " "), lambda w: w != "")


def measures(pairs: DataFrame, spoken_form: bool = True) -> DataFrame:
    """Add counts and WER, MER, WIL, WIP to rows with ref and hyp texts.

    An empty reference scores WER 1 with no reference words and no other measures.
    """
    names = [c for c in pairs.columns if c not in ("rw", "hw")]
    rows = pairs
    if "rw" not in pairs.columns:
        rows = pairs.withColumns({"rw": words(F.col("ref"), spoken_form), "hw": words(F.col("hyp"), spoken_form)})
    rows = rows.withColumns({"num_ref_words": F.size("rw"), "num_hyp_words": F.size("hw")})
    rows = rows.withColumn("e", word_edits("rw", "hw"))
    some = F.col("num_ref_words") > 0
    s, d, i, h = (F.col(f"e.{n}") for n in ("substitutions", "deletions", "insertions", "hits"))
    nr, nh = F.col("num_ref_words"), F.col("num_hyp_words")
    wip = F.when(nh > 0, h / nr * (h / nh)).otherwise(F.lit(0.0))
    return rows.select(
        *names, "num_ref_words", "num_hyp_words",
        F.when(some, s).alias("substitutions"), F.when(some, d).alias("deletions"),
        F.when(some, i).alias("insertions"), F.when(some, h).alias("hits"),
        F.when(some, (s + d + i) / nr).otherwise(1.0).alias("wer"),
        F.when(some, (s + d + i) / (h + s + d + i)).alias("mer"),
        F.when(some, 1.0 - wip).alias("wil"),
        F.when(some, wip).alias("wip"),
    )


def pair_samples(
    truth: DataFrame, transcript: DataFrame, mode: str = "intersection", spoken_form: bool | None = None
) -> DataFrame:
    """Reference and hypothesis per (model, sample).

    'intersection': ids on both sides per model. 'any_model': every model gets each id that the truth and at
    least one model have; a missing hypothesis is ''. With `spoken_form` set the words to compare come along
    as rw and hw; each text is then normalised once, before it is paired.
    """
    def split(text: Column) -> list[Column]:
        return [] if spoken_form is None else [words(text, spoken_form)]

    if spoken_form is not None:
        # the shuffle of the join comes first, so the costly normalisation runs evenly on its partitions
        truth, transcript = truth.repartition("sample_id"), transcript.repartition("sample_id")
    ref = truth.select("sample_id", F.col("text").alias("ref"), *[w.alias("rw") for w in split(F.col("text"))])
    hyp = transcript.select(
        "model", "sample_id", F.col("text").alias("hyp"), *[w.alias("hw") for w in split(F.col("text"))]
    )
    extra = [] if spoken_form is None else ["rw", "hw"]
    if mode == "intersection":
        return hyp.join(ref, "sample_id").select("model", "sample_id", "ref", "hyp", *extra)
    ids = hyp.select("sample_id").distinct()
    models = hyp.select("model").distinct()
    # every model has a row for every sample: an equi-join on a salt, the few model names sit on each salt
    left, right = salted(ref.join(ids, "sample_id", "left_semi"), models, 16, ["sample_id"])
    grid = left.join(right, "salt").drop("salt")
    fill = {"hyp": F.coalesce("hyp", F.lit(""))}
    if extra:
        fill["hw"] = F.coalesce("hw", F.array().cast("array<string>"))
    return grid.join(hyp, ["model", "sample_id"], "left").withColumns(fill).select(
        "model", "sample_id", "ref", "hyp", *extra
    )


def score_asr(truth: DataFrame, transcript: DataFrame, mode: str = "intersection", spoken_form: bool = True) -> DataFrame:
    """Measures of every pair. Texts repeat a lot: each distinct text is split once and each distinct pair scored once."""
    pairs = pair_samples(truth, transcript, mode)
    different = cut(pairs.select("ref", "hyp").distinct())
    texts = different.select(F.col("ref").alias("text")).unionByName(different.select(F.col("hyp").alias("text")))
    split = once_per_value(texts, "text", {"w": words(F.col("text"), spoken_form)})
    for side, name in (("ref", "rw"), ("hyp", "hw")):
        different = join_nulls(different, split.select(F.col("text").alias(side), F.col("w").alias(name)), [side])
    return join_nulls(pairs, cut(measures(different, spoken_form)), ["ref", "hyp"])


def summarise(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """WER weighted by reference words, plain means of the others, totals."""
    n = F.sum("num_ref_words")
    return scores.groupBy(*by).agg(
        F.when(n > 0, F.sum(F.col("wer") * F.col("num_ref_words")) / n).otherwise(0.0).alias("average_wer"),
        F.coalesce(F.avg("mer"), F.lit(0.0)).alias("average_mer"),
        F.coalesce(F.avg("wil"), F.lit(0.0)).alias("average_wil"),
        F.coalesce(F.avg("wip"), F.lit(0.0)).alias("average_wip"),
        n.alias("total_ref_words"), F.sum("num_hyp_words").alias("total_hyp_words"),
        F.count("*").alias("num_samples"),
        *[F.sum(c).alias(f"total_{c}") for c in ("substitutions", "insertions", "deletions", "hits")],
    )


def rank_models(summary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Best WER first; a summary has one row per model."""
    w = Window.partitionBy(*by).orderBy("average_wer", "model")
    return summary.withColumn("rank", F.row_number().over(w))


def wer_cdf(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Share of samples at or below each WER value.

    Equal values are counted first; sums then run inside ranges of distinct values, and over one row per range.
    """
    by = list(by)
    counts = scores.groupBy(*by, "wer").agg(F.count("*").alias("c"))
    counts = counts.withColumn("range", F.floor(F.col("wer") * 1000))
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy(*by, "range").agg(F.sum("c").alias("r"))
    ranges = ranges.select(*by, "range", F.coalesce(F.sum("r").over(before), F.lit(0)).alias("before"), F.sum("r").over(Window.partitionBy(*by)).alias("n"))
    inside = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*by, "range").orderBy("wer")))
    return inside.join(ranges, [*by, "range"]).select(*by, "wer", ((F.col("before") + F.col("upto")) / F.col("n")).alias("share"))


def wer_by_length(scores: DataFrame) -> DataFrame:
    return scores.select("model", "sample_id", "num_ref_words", "wer")


def best_models(summary: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Best model per dataset and measure: low error measures, high information preserved."""
    return summary.groupBy(dataset).agg(
        *[F.min_by("model", F.struct(f"average_{m}", "model")).alias(f"best_{m}") for m in ("wer", "mer", "wil")],
        F.min_by("model", F.struct(-F.col("average_wip"), F.col("model"))).alias("best_wip"),
    )


def pending(files: DataFrame, results: DataFrame) -> DataFrame:
    """(model, file) work that has no successful result."""
    return files.join(results.where(F.col("error").isNull()).select("model", "file").distinct(), ["model", "file"], "left_anti")


def finished_models(files: DataFrame, results: DataFrame) -> DataFrame:
    """Models whose required files all have a successful result."""
    left = pending(files, results).select("model").distinct().withColumn("open", F.lit(True))
    return files.select("model").distinct().join(left, "model", "left").select("model", F.col("open").isNull().alias("done"))


def run_totals(results: DataFrame) -> DataFrame:
    ok = F.col("error").isNull()
    return results.groupBy("model").agg(
        F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed")
    )
