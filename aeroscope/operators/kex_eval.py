"""Quality of extracted records: matching, fields, references, duplicates, scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroscope.idioms import ratio
from aeroscope.operators.matching import greedy_match
from aeroscope.session import cut

THRESHOLD = 0.70
DUPLICATE_SCORE = 0.80
# Compared fields and enum fields per type, and score weights.
CONTENT_FIELDS = {
    "entity": ("text", "label", "subtype", "context", "aliases"),
    "relationship": ("subject_text", "predicate", "object_text", "relation_type", "context"),
    "event": ("event_type", "trigger_text", "actors", "targets", "phase", "parameters", "temporal_context"),
    "krule": (
        "rule_type", "modality", "deontic_strength", "severity", "safety_critical", "explainability",
        "linked_entities", "linked_relationships", "preconditions",
    ),
    "procedure": ("name", "purpose", "context", "mandatory_order", "preconditions", "exceptions", "linked_rules"),
}
ENUM_FIELDS = {
    "entity": (), "relationship": ("relation_type",), "event": ("phase",),
    "krule": ("rule_type", "modality", "deontic_strength", "severity"), "procedure": (),
}
WEIGHTS = {"structural": 0.15, "content": 0.10, "cross_ref": 0.15, "semantic": 0.55, "error": 0.05}
CONTAINED = {
    "relationship": {"subject_id": "entity", "object_id": "entity"},
    "event": {"actors": "entity", "targets": "entity"},
    "krule": {"linked_entities": "entity", "linked_relationships": "relationship"},
    "procedure": {"linked_rules": "krule"},
}
REF_NAMES = {
    "subject_id": "subject_id", "object_id": "object_id", "actors": "actor", "targets": "target",
    "linked_entities": "linked_entity", "linked_relationships": "linked_rel", "linked_rules": "linked_rule",
}
SHOWN_FIELDS = {
    "entity": ("text", "label", "subtype", "context", "aliases", "formal_definition"),
    "relationship": ("subject_text", "predicate", "object_text", "relation_type"),
    "event": ("event_type", "trigger_text", "actors", "targets", "phase"),
    "krule": ("rule_type", "modality", "deontic_strength", "trigger_text", "constraint_text", "if_cond"),
    "procedure": ("name", "purpose", "steps", "preconditions"),
}
PAGE = ("model", "page")


def _c(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def match_key(kind: str) -> Column:
    if kind == "relationship":
        return F.concat_ws(" ", _c("subject_text"), _c("predicate"), _c("object_text"))
    return _c({"entity": "text", "event": "trigger_text", "krule": "trigger_text", "procedure": "name"}[kind])


def exact_key(kind: str) -> Column:
    if kind == "relationship":
        return F.concat_ws("|", *[F.lower(F.trim(_c(c))) for c in ("subject_text", "predicate", "object_text")])
    return F.lower(F.trim(match_key(kind)))


def keyed(records: Mapping[str, DataFrame]) -> DataFrame:
    """All record types in one narrow table: run, page, kind, n (chunk and position in it), key texts."""
    parts = [
        df.select(
            "run", "page", F.lit(k).alias("kind"), (F.col("chunk").cast("bigint") * (1 << 32) + F.col("idx")).alias("n"),
            "seq", match_key(k).alias("key"), exact_key(k).alias("exact"),
        )
        for k, df in records.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def match_records(rows: DataFrame, truth: str = "gt", threshold: float = THRESHOLD) -> DataFrame:
    """Greedy matches per (model, page, kind): i = true position, j = model position. Empty keys never match."""
    key = F.trim(F.lower("key"))
    named = rows.where(F.col("key") != "").withColumn("txt", key)
    right = named.where(F.col("run") != truth).select(F.col("run").alias("model"), "page", "kind", F.col("n").alias("j"), "txt")
    pages = rows.where(F.col("run") != truth).select(F.col("run").alias("model"), "page").distinct()
    left = named.where(F.col("run") == truth).select("page", "kind", F.col("n").alias("i"), "txt").join(pages, "page")
    return greedy_match(left.select("model", "page", "kind", "i", "txt"), right, ["model", "page", "kind"], threshold)


def counts(rows: DataFrame, truth: str = "gt") -> DataFrame:
    """Counts per (model, page, kind) on pages both sides have, zero rows included. Accuracy may go negative."""
    per = rows.groupBy("run", "page", "kind").agg(F.count("*").alias("c"))
    kinds = F.explode(F.array(*[F.lit(k) for k in CONTENT_FIELDS])).alias("kind")
    gt_pages = rows.where(F.col("run") == truth).select("page").distinct()
    grid = rows.where(F.col("run") != truth).select(F.col("run").alias("model"), "page").distinct().join(gt_pages, "page").select("model", "page", kinds)
    g = per.where(F.col("run") == truth).select("page", "kind", F.col("c").alias("gt_count"))
    m = per.where(F.col("run") != truth).select(F.col("run").alias("model"), "page", "kind", F.col("c").alias("model_count"))
    out = grid.join(g, ["page", "kind"], "left").join(m, ["model", "page", "kind"], "left").na.fill(0, ["gt_count", "model_count"])
    err = F.abs(F.col("gt_count") - F.col("model_count"))
    return out.withColumns(
        {"count_error": err, "count_accuracy": 1.0 - err / F.greatest(F.col("gt_count"), F.lit(1))}
    )


def structural(count_rows: DataFrame, matches: DataFrame) -> DataFrame:
    """Precision, recall and F1 per (model, page, kind)."""
    tp = matches.groupBy("model", "page", "kind").agg(F.count("*").alias("tp"))
    j = count_rows.join(tp, ["model", "page", "kind"], "left").na.fill(0, ["tp"])
    p, r = ratio(F.col("tp"), F.col("model_count")), ratio(F.col("tp"), F.col("gt_count"))
    return j.withColumns({"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)})


def field_scores(records: Mapping[str, DataFrame], matches: DataFrame, truth: str = "gt") -> DataFrame:
    """Content score per matched pair: half exact-field share, half enum share (0 without enum fields)."""
    out = []
    for kind, df in records.items():
        n = F.col("chunk").cast("bigint") * (1 << 32) + F.col("idx")
        fields = [f for f in CONTENT_FIELDS[kind] if f in df.columns]
        # a field neither side has is equal on both
        absent = len(CONTENT_FIELDS[kind]) - len(fields)
        gt = df.where(F.col("run") == truth).select("page", n.alias("i"), F.struct(*fields).alias("g"))
        md = df.where(F.col("run") != truth).select(F.col("run").alias("model"), "page", n.alias("j"), F.struct(*fields).alias("m"))
        pairs = matches.where(F.col("kind") == kind).join(gt, ["page", "i"]).join(md, ["model", "page", "j"])

        def same(names: Sequence[str]) -> Column:
            return sum((F.col(f"g.{f}").eqNullSafe(F.col(f"m.{f}")).cast("int") for f in names), F.lit(0))

        exact = (same(fields) + absent) / len(CONTENT_FIELDS[kind])
        enums = ENUM_FIELDS[kind]
        enum = same(enums) / len(enums) if enums else F.lit(0.0)
        out.append(
            pairs.select(
                "model", "page", "kind", "i", "j", exact.alias("exact_ratio"), enum.alias("enum_ratio"),
                ((exact + enum) / 2).alias("content"),
            )
        )
    return reduce(DataFrame.unionByName, out)


def references(records: Mapping[str, DataFrame]) -> DataFrame:
    """Every reference with whether its id exists on the same page of the same run."""
    ids = reduce(
        DataFrame.unionByName,
        [df.where(F.col("id") != "").select("run", "page", F.lit(k).alias("target"), F.col("id").alias("ref")) for k, df in records.items()],
    ).distinct().withColumn("found", F.lit(True))
    refs = []
    for kind, fields in CONTAINED.items():
        df = records[kind]
        for field, target in fields.items():
            is_list = dict(df.dtypes)[field].startswith("array")
            one = F.explode(field) if is_list else F.col(field)
            r = df.select("run", "page", "id", one.alias("ref"))
            if not is_list:
                r = r.where(F.coalesce("ref", F.lit("")) != "")
            refs.append(r.select("run", "page", F.lit(kind).alias("kind"), "id", F.lit(REF_NAMES[field]).alias("field"), F.lit(target).alias("target"), "ref"))
    return reduce(DataFrame.unionByName, refs).join(ids, ["run", "page", "target", "ref"], "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def reference_validity(refs: DataFrame) -> DataFrame:
    """Share of existing references per (run, page, kind). Broken ones are listed by `broken_references`."""
    return refs.groupBy("run", "page", "kind").agg(
        F.count("*").alias("total_refs"), F.count_if("found").alias("valid_refs"),
        (F.count_if("found") / F.count("*")).alias("validity"),
    )


def broken_references(refs: DataFrame) -> DataFrame:
    return refs.where(~F.col("found")).select(
        "run", "page", "kind", F.concat(F.col("id"), F.lit("."), "field", F.lit("="), "ref").alias("broken")
    )


def page_rollup(struct_rows: DataFrame, content: DataFrame, validity: DataFrame, errors: DataFrame) -> DataFrame:
    """Means over the five types per page, and error counts and rate."""
    avg_content = content.groupBy("model", "page", "kind").agg(F.avg("content").alias("content"))
    v = validity.select(F.col("run").alias("model"), "page", "kind", "validity")
    rows = struct_rows.join(avg_content, ["model", "page", "kind"], "left").join(v, ["model", "page", "kind"], "left")
    rows = rows.na.fill(0.0, ["content"]).na.fill(1.0, ["validity"])
    pages = rows.groupBy(*PAGE).agg(
        F.sum("gt_count").alias("gt_items"), F.sum("model_count").alias("model_items"),
        *[F.avg(c).alias(c) for c in ("precision", "recall", "f1", "content")], F.avg("validity").alias("cross_ref"),
    )
    e = errors.select(F.col("run").alias("model"), "page", "chunk", "type").groupBy(*PAGE).agg(
        F.count("*").alias("total_errors"), F.count_if(F.col("type") == "extraction_failed").alias("extraction_failures"),
        F.count_if(F.col("type") == "invalid_cross_reference").alias("invalid_refs"),
        F.count_distinct("chunk").alias("chunks_with_errors"),
    )
    names = ["total_errors", "extraction_failures", "invalid_refs", "chunks_with_errors"]
    out = pages.join(e, list(PAGE), "left").na.fill(0, names)
    return out.withColumn("error_rate", F.col("total_errors") / F.greatest(F.col("model_items"), F.lit(1)))


def exact_groups(rows: DataFrame) -> DataFrame:
    """Keys that occur more than once over all pages of a run."""
    return (
        rows.where(F.col("exact") != "").groupBy("run", "kind", "exact")
        .agg(F.count("*").alias("size"), F.min("seq").alias("first"))
        .where("size > 1")
    )


def duplicate_edges(rows: DataFrame, verdicts: DataFrame, threshold: float = DUPLICATE_SCORE) -> DataFrame:
    """Edges run, kind, u, v: each copy to the first of its key, and verdict pairs above the threshold."""
    copies = rows.join(exact_groups(rows), ["run", "kind", "exact"]).where(F.col("seq") != F.col("first")).select(
        "run", "kind", F.col("seq").alias("u"), F.col("first").alias("v")
    )
    judged = verdicts.where(F.col("is_duplicate") & (F.col("score") >= threshold)).select(
        "run", "kind", F.col("i").alias("u"), F.col("j").alias("v")
    )
    return copies.unionByName(judged)


def clusters(edges: DataFrame) -> DataFrame:
    """Connected components: run, kind, node, cluster (smallest node).

    Alternates the star steps of Kiveris et al. (Connected Components in MapReduce and Beyond): every node
    links its larger neighbours, then its smaller ones, to the smallest node it knows. The number of rounds
    grows with the logarithm of the component size; lineage is cut by reliable checkpoints.
    """
    key = ["run", "kind"]

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(*key, F.col("v").alias("u"), F.col("u").alias("v")))

    def large(e: DataFrame) -> DataFrame:
        e = both(e)
        low = e.groupBy(*key, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        j = e.where("v > u").join(low, [*key, "u"])
        return j.select(*key, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(*key, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy(*key, "u").agg(F.min("v").alias("m"))
        j = down.join(low, [*key, "u"])
        moved = j.where("v <> m").select(*key, F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(low.select(*key, "u", F.col("m").alias("v"))).distinct()

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*key, "u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    now = cut(edges.where("u <> v").distinct())
    seen = mark(now)
    while True:
        now = cut(small(large(now)))
        after = mark(now)
        if after == seen:
            break
        seen = after
    roots = now.select(*key, F.col("v").alias("node"), F.col("v").alias("cluster")).distinct()
    return now.select(*key, F.col("u").alias("node"), F.col("v").alias("cluster")).unionByName(roots).distinct()


def cluster_stats(labels: DataFrame, rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Size and mean known edge score per cluster.

    All pairs of equal keys count as known edges with score 1 (their number is computed, not listed) unless
    a verdict gives the pair another score.
    """
    key = ["run", "kind"]
    size = labels.groupBy(*key, "cluster").agg(F.count("*").alias("size"))
    group = exact_groups(rows).select(*key, F.col("first").alias("node"), (F.col("size") * (F.col("size") - 1) / 2).alias("pairs"))
    exact = group.join(labels, [*key, "node"]).groupBy(*key, "cluster").agg(F.sum("pairs").alias("pairs"))
    at = rows.select(*key, F.col("seq").alias("node"), F.nullif("exact", F.lit("")).alias("exact"))
    side = labels.join(at, [*key, "node"], "left")
    a = side.select(*key, F.col("node").alias("i"), F.col("cluster"), F.col("exact").alias("xa"))
    b = side.select(*key, F.col("node").alias("j"), F.col("cluster").alias("cj"), F.col("exact").alias("xb"))
    known = verdicts.join(a, [*key, "i"]).join(b, [*key, "j"]).where(F.col("cluster") == F.col("cj"))
    judged = known.groupBy(*key, "cluster").agg(
        F.count("*").alias("n"), F.sum("score").alias("s"), F.count_if(F.col("xa") == F.col("xb")).alias("over")
    )
    out = size.join(exact, [*key, "cluster"], "left").join(judged, [*key, "cluster"], "left").na.fill(0, ["pairs", "n", "s", "over"])
    known_pairs = F.col("pairs") - F.col("over") + F.col("n")
    total = F.col("pairs") - F.col("over") + F.col("s")
    return out.select(*key, "cluster", "size", ratio(total, known_pairs).alias("avg_similarity"))


def duplication(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Report per (run, kind) and per run (kind null); duplicates count all members of a cluster."""
    total = rows.groupBy("run", "kind").agg(F.count("*").alias("total_items"))
    d = stats.groupBy("run", "kind").agg(
        F.sum("size").alias("duplicate_count"), F.count("*").alias("cluster_count"), F.max("size").alias("max_cluster_size")
    )
    j = total.join(d, ["run", "kind"], "left").na.fill(0)
    out = j.groupingSets([["run", "kind"], ["run"]], "run", "kind").agg(
        F.sum("total_items").alias("total_items"), F.sum("duplicate_count").alias("duplicate_count"),
        F.sum("cluster_count").alias("cluster_count"), F.max("max_cluster_size").alias("max_cluster_size"),
    )
    return out.withColumns(
        {
            "unique_items": F.col("total_items") - F.col("duplicate_count"),
            "duplication_rate": ratio(F.col("duplicate_count"), F.col("total_items")),
        }
    )


def semantic_pages(scores: DataFrame) -> DataFrame:
    """Chunk mean over types, page mean over chunks, nulls skipped. Both sides empty scores 1."""
    value = F.when(F.col("both_empty"), 1.0).otherwise(F.col("score"))
    chunk = scores.withColumn("s", value).where("s is not null").groupBy("model", "page", "chunk").agg(F.avg("s").alias("s"))
    return chunk.groupBy(*PAGE).agg(F.avg("s").alias("semantic"))


def page_scores(pages: DataFrame, semantic: DataFrame, dedup: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Weighted page score, error score and duplicate score (run level rate)."""
    d = dedup.where(F.col("kind").isNull()).select(F.col("run").alias("model"), (1.0 - F.least("duplication_rate", F.lit(1.0))).alias("dedup_score"))
    rows = pages.join(semantic, list(PAGE), "left").join(d, "model", "left").na.fill(0.0, ["semantic", "dedup_score"])
    err = 1.0 - F.least(F.col("total_errors") / F.greatest(F.col("model_items"), F.lit(1)), F.lit(1.0))
    rows = rows.withColumn("error_score", err)
    parts = {"structural": "f1", "content": "content", "cross_ref": "cross_ref", "semantic": "semantic", "error": "error_score"}
    return rows.withColumn("overall", sum(F.col(parts[n]) * w for n, w in weights.items()))


def model_scores(page_rows: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Means over pages, the weighted score of the means, and the rank (one row per model)."""
    names = ("precision", "recall", "f1", "content", "cross_ref", "semantic", "dedup_score", "error_score")
    m = page_rows.groupBy("model").agg(*[F.avg(n).alias(n) for n in names])
    parts = {"structural": "f1", "content": "content", "cross_ref": "cross_ref", "semantic": "semantic", "error": "error_score"}
    m = m.withColumn("overall", sum(F.col(parts[n]) * w for n, w in weights.items()))
    return rank_models(m)


def rank_models(scores: DataFrame) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("overall"), "model")))


def strip_ids(text: Column) -> Column:
    """Replace internal ids by <ID>."""
    for p in (r"\b[RE]V?\d{2,4}\b", r"\bRULE\d{2,4}\b", r"\bP\d{2,4}\b"):
        text = F.regexp_replace(text, p, "<ID>")
    return F.regexp_replace(text, "  +", " ")


def flat_lines(df: DataFrame, kind: str) -> Column:
    """Record as 'field: value' lines without internal ids."""
    types = dict(df.dtypes)
    lines = []
    for f in SHOWN_FIELDS[kind]:
        if f not in types:
            value = F.lit("N/A")
        elif types[f].startswith("array"):
            value = F.when(F.size(f) > 0, F.array_join(f, ", ")).otherwise("[]")
        else:
            value = F.coalesce(F.col(f).cast("string"), F.lit("N/A"))
        lines.append(F.concat(F.lit(f"    {f}: "), strip_ids(value)))
    return F.concat_ws("\n", *lines)


def config_hash(config: Column) -> Column:
    """Hash of a configuration struct."""
    return F.sha2(F.to_json(config), 256)


def open_units(units: DataFrame, done: DataFrame) -> DataFrame:
    """Units without a result under the same configuration hash."""
    return units.join(done.select("unit", "config_hash").distinct(), ["unit", "config_hash"], "left_anti")
