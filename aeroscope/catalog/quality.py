"""Transcript, chunk and record quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from aeroscope.catalog import query
from aeroscope.fixtures import chunks, records, table
from aeroscope.functions.fuzzy import indel_ratio
from aeroscope.operators import asr_eval as asr
from aeroscope.operators import chunk_eval as ch
from aeroscope.operators import extraction as ex
from aeroscope.operators import kex_eval as kx
from aeroscope.operators import matching


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


# ---- A: transcripts ---------------------------------------------------------------------------------


def _scores(spark, sf, mode="intersection"):
    return asr.score_asr(table(spark, sf, "truth"), table(spark, sf, "transcript"), mode)


@query("A1_wer")
def a1(spark, sf):
    return r6(_scores(spark, sf).select("model", "sample_id", "wer", "num_ref_words", "num_hyp_words"), "wer")


@query("A2_operations")
def a2(spark, sf):
    return _scores(spark, sf).select("model", "sample_id", "substitutions", "deletions", "insertions", "hits")


@query("A3_measures")
def a3(spark, sf):
    return r6(_scores(spark, sf).select("model", "sample_id", "mer", "wil", "wip"), "mer", "wil", "wip")


@query("A4_pairs", "SELECT p.model, p.sample_id, t.text AS ref, p.text AS hyp FROM transcript p JOIN truth t ON p.sample_id = t.sample_id")
def a4(spark, sf):
    return asr.pair_samples(table(spark, sf, "truth"), table(spark, sf, "transcript"))


SUMMARY_SQL = """round(sum(wer * num_ref_words) / sum(num_ref_words), 6) AS average_wer, round(avg(mer), 6) AS average_mer, round(avg(wil), 6) AS average_wil, round(avg(wip), 6) AS average_wip,
 sum(num_ref_words)::bigint AS total_ref_words, sum(num_hyp_words)::bigint AS total_hyp_words, count(*) AS num_samples, sum(substitutions)::bigint AS total_substitutions,
 sum(insertions)::bigint AS total_insertions, sum(deletions)::bigint AS total_deletions, sum(hits)::bigint AS total_hits"""
AVERAGES = ("average_wer", "average_mer", "average_wil", "average_wip")


@query("A5_summary", f"SELECT model, {SUMMARY_SQL} FROM asr_score GROUP BY model")
def a5(spark, sf):
    return r6(asr.summarise(table(spark, sf, "asr_score")), *AVERAGES)


@query("A6_any_model", """WITH ids AS (SELECT DISTINCT sample_id FROM transcript), m AS (SELECT DISTINCT model FROM transcript)
SELECT m.model, t.sample_id, t.text AS ref, coalesce(p.text, '') AS hyp FROM truth t JOIN ids ON t.sample_id = ids.sample_id CROSS JOIN m
LEFT JOIN transcript p ON p.model = m.model AND p.sample_id = t.sample_id""")
def a6(spark, sf):
    return asr.pair_samples(table(spark, sf, "truth"), table(spark, sf, "transcript"), "any_model")


@query("A7_rank", "SELECT model, round(sum(wer * num_ref_words) / sum(num_ref_words), 6) AS average_wer, row_number() OVER (ORDER BY sum(wer * num_ref_words) / sum(num_ref_words), model) AS rank FROM asr_score GROUP BY model")
def a7(spark, sf):
    return r6(asr.rank_models(asr.summarise(table(spark, sf, "asr_score"))), "average_wer").select("model", "average_wer", "rank")


@query("A8_cdf", """WITH c AS (SELECT dataset, model, wer, count(*) AS c FROM asr_score GROUP BY 1, 2, 3)
SELECT dataset, model, round(wer, 6) AS wer, round(sum(c) OVER (PARTITION BY dataset, model ORDER BY wer) / sum(c) OVER (PARTITION BY dataset, model), 6) AS share FROM c""")
def a8(spark, sf):
    return r6(asr.wer_cdf(table(spark, sf, "asr_score"), ["dataset", "model"]), "wer", "share")


@query("A9_by_length", "SELECT model, sample_id, num_ref_words, round(wer, 6) AS wer FROM asr_score")
def a9(spark, sf):
    return r6(asr.wer_by_length(table(spark, sf, "asr_score")), "wer")


@query("A10_best", f"""WITH s AS (SELECT dataset, model, sum(wer * num_ref_words) / sum(num_ref_words) AS w, avg(mer) AS m, avg(wil) AS l, avg(wip) AS p FROM asr_score GROUP BY 1, 2)
SELECT dataset, arg_min(model, w) AS best_wer, arg_min(model, m) AS best_mer, arg_min(model, l) AS best_wil, arg_max(model, p) AS best_wip FROM s GROUP BY 1""")
def a10(spark, sf):
    return asr.best_models(asr.summarise(table(spark, sf, "asr_score"), ["dataset", "model"]))


def _work(spark, sf):
    s = table(spark, sf, "transcript")
    files = s.select("model", F.col("sample_id").alias("file"))
    results = files.where("file % 3 <> 0").withColumn("error", F.when(F.col("file") % 5 == 0, "failed"))
    return files, results


@query("A11_pending", "SELECT model, sample_id AS file FROM transcript WHERE sample_id % 3 = 0 OR sample_id % 5 = 0")
def a11(spark, sf):
    return asr.pending(*_work(spark, sf))


@query("A11_done", "SELECT model, NOT bool_or((sample_id % 3 = 0 OR sample_id % 5 = 0) AND model <> 'm1') AS done FROM transcript GROUP BY model")
def a11_done(spark, sf):
    files, results = _work(spark, sf)
    good = files.where("model = 'm1'").withColumn("error", F.lit(None).cast("string"))
    return asr.finished_models(files, results.unionByName(good))


@query("A12_totals", """SELECT model, count(*) AS total, count(*) FILTER (sample_id % 5 <> 0) AS succeeded, count(*) FILTER (sample_id % 5 = 0) AS failed FROM transcript WHERE sample_id % 3 <> 0 GROUP BY 1""")
def a12(spark, sf):
    return asr.run_totals(_work(spark, sf)[1])


# ---- B: chunks --------------------------------------------------------------------------------------


@query("B1_ratio")
def b1(spark, sf):
    t, m = chunks(spark, sf)
    j = m.join(t.withColumnRenamed("text", "gt"), ["page", "chunk"])
    return j.select("model", "page", "chunk", F.round(indel_ratio("text", "gt"), 6).alias("score"))


def _chunk_pages(spark, sf):
    t, m = chunks(spark, sf)
    return ch.page_metrics(t, m, ch.match_chunks(t, m))


@query("B2_match")
def b2(spark, sf):
    return r6(ch.match_chunks(*chunks(spark, sf)), "score")


@query("B3_structure")
def b3(spark, sf):
    p = _chunk_pages(spark, sf)
    return r6(p, "chunk_count_accuracy", "boundary_precision", "boundary_recall", "boundary_f1", "boundary_avg_error").select(
        "model", "page", "count_error", "chunk_count_accuracy", "boundary_precision", "boundary_recall", "boundary_f1", "boundary_avg_error"
    )


@query("B4_content")
def b4(spark, sf):
    names = ("matched_content_precision", "matched_content_recall", "matched_content_f1")
    return r6(_chunk_pages(spark, sf), *names).select("model", "page", *names)


@query("B5_page_integrity")
def b5(spark, sf):
    return r6(ch.page_integrity(chunks(spark, sf)[1]), "boundary_integrity")


def _sentences(truth):
    return truth.select("page", "chunk", "text")


@query("B5_document_integrity")
def b5_document(spark, sf):
    t, m = chunks(spark, sf)
    return r6(ch.document_integrity(m, _sentences(t)), "boundary_integrity")


@query("B6_summary")
def b6(spark, sf):
    t, m = chunks(spark, sf)
    out = ch.model_summary(ch.page_metrics(t, m, ch.match_chunks(t, m)), ch.document_integrity(m, _sentences(t)))
    return r6(out, *[c for c in out.columns if c != "model"])


@query("B7_pages", "SELECT page_id AS page FROM pages INTERSECT SELECT doc_id FROM documents")
def b7(spark, sf):
    return ch.common_pages(
        table(spark, sf, "pages").select(F.col("page_id").alias("page")), table(spark, sf, "documents").select(F.col("doc_id").alias("page"))
    )


# ---- Q: records -------------------------------------------------------------------------------------

KEYS_SQL = """kr AS (
 SELECT run, page, 'entity' AS kind, chunk * 4294967296 + idx AS n, seq, coalesce(text, '') AS key, trim(lower(coalesce(text, ''))) AS exact FROM entity
 UNION ALL SELECT run, page, 'relationship', chunk * 4294967296 + idx, seq, concat_ws(' ', subject_text, predicate, object_text), concat_ws('|', trim(lower(subject_text)), trim(lower(predicate)), trim(lower(object_text))) FROM relationship
 UNION ALL SELECT run, page, 'event', chunk * 4294967296 + idx, seq, trigger_text, trim(lower(trigger_text)) FROM event
 UNION ALL SELECT run, page, 'krule', chunk * 4294967296 + idx, seq, trigger_text, trim(lower(trigger_text)) FROM krule
 UNION ALL SELECT run, page, 'procedure', chunk * 4294967296 + idx, seq, name, trim(lower(name)) FROM procedure)"""


def _rows(spark, sf):
    return kx.keyed(records(spark, sf))


@query("Q1_keys", f"WITH {KEYS_SQL} SELECT run, page, kind, n, key, exact FROM kr")
def q1(spark, sf):
    return _rows(spark, sf).select("run", "page", "kind", "n", "key", "exact")


@query("Q2_fuzzy")
def q2(spark, sf):
    e = records(spark, sf)["entity"]
    gt = e.where("run = 'gt'").select("seq", F.col("text").alias("gt"))
    m = e.where("run <> 'gt'").select("run", "seq", "text")
    return m.join(gt, "seq").select("run", "seq", F.round(matching.fuzzy_score(F.col("gt"), F.col("text")), 6).alias("score"))


@query("Q3_match")
def q3(spark, sf):
    return r6(kx.match_records(_rows(spark, sf)), "score")



@query("Q4_counts", f"""WITH {KEYS_SQL}, kinds AS (SELECT unnest(['entity', 'relationship', 'event', 'krule', 'procedure']) AS kind),
mp AS (SELECT DISTINCT run AS model, page FROM kr WHERE run <> 'gt' AND page IN (SELECT page FROM kr WHERE run = 'gt')),
c AS (SELECT run, page, kind, count(*) AS c FROM kr GROUP BY 1, 2, 3)
SELECT mp.model, mp.page, kinds.kind, coalesce(g.c, 0) AS gt_count, coalesce(m.c, 0) AS model_count, abs(coalesce(g.c, 0) - coalesce(m.c, 0)) AS count_error,
 round(1.0 - abs(coalesce(g.c, 0) - coalesce(m.c, 0)) / greatest(coalesce(g.c, 0), 1)::double, 6) AS count_accuracy
FROM mp CROSS JOIN kinds LEFT JOIN c g ON g.run = 'gt' AND g.page = mp.page AND g.kind = kinds.kind LEFT JOIN c m ON m.run = mp.model AND m.page = mp.page AND m.kind = kinds.kind""")
def q4(spark, sf):
    return r6(kx.counts(_rows(spark, sf)), "count_accuracy")


def _content(spark, sf):
    rec = records(spark, sf)
    return rec, kx.match_records(kx.keyed(rec))


@query("Q5_fields")
def q5(spark, sf):
    return r6(kx.field_scores(*_content(spark, sf)), "exact_ratio", "enum_ratio", "content")


def _page_rows(spark, sf):
    rec = records(spark, sf)
    rows = kx.keyed(rec)
    m = kx.match_records(rows)
    return kx.page_rollup(
        kx.structural(kx.counts(rows), m), kx.field_scores(rec, m), kx.reference_validity(kx.references(rec)), ex.clean(rec)[1]
    )


@query("Q6_pages")
def q6(spark, sf):
    return r6(_page_rows(spark, sf), "precision", "recall", "f1", "content", "cross_ref", "error_rate")


REF_SQL = """ids AS (SELECT DISTINCT run, page, 'entity' AS target, id AS ref FROM entity WHERE id <> '' UNION SELECT run, page, 'relationship', id FROM relationship WHERE id <> ''
 UNION SELECT run, page, 'krule', id FROM krule),
rf AS (SELECT run, page, 'relationship' AS kind, id, 'subject_id' AS field, 'entity' AS target, subject_id AS ref FROM relationship WHERE subject_id <> ''
 UNION ALL SELECT run, page, 'relationship', id, 'object_id', 'entity', object_id FROM relationship WHERE object_id <> ''
 UNION ALL SELECT run, page, 'event', id, 'actor', 'entity', unnest(string_split(actors_csv, ',')) FROM event WHERE actors_csv <> ''
 UNION ALL SELECT run, page, 'event', id, 'target', 'entity', unnest(string_split(targets_csv, ',')) FROM event WHERE targets_csv <> ''
 UNION ALL SELECT run, page, 'krule', id, 'linked_entity', 'entity', unnest(string_split(linked_entities_csv, ',')) FROM krule
 UNION ALL SELECT run, page, 'krule', id, 'linked_rel', 'relationship', unnest(string_split(linked_relationships_csv, ',')) FROM krule
 UNION ALL SELECT run, page, 'procedure', id, 'linked_rule', 'krule', unnest(string_split(linked_rules_csv, ',')) FROM procedure),
rx AS (SELECT rf.*, ids.ref IS NOT NULL AS found FROM rf LEFT JOIN ids ON rf.run = ids.run AND rf.page = ids.page AND rf.target = ids.target AND rf.ref = ids.ref)"""


@query("Q7_references", f"WITH {REF_SQL} SELECT run, page, kind, count(*) AS total_refs, count(*) FILTER (found) AS valid_refs, round(count(*) FILTER (found) / count(*)::double, 6) AS validity FROM rx GROUP BY 1, 2, 3")
def q7(spark, sf):
    return r6(kx.reference_validity(kx.references(records(spark, sf))), "validity")


@query("Q7_broken", f"WITH {REF_SQL} SELECT run, page, kind, id || '.' || field || '=' || ref AS broken FROM rx WHERE NOT found")
def q7_broken(spark, sf):
    return kx.broken_references(kx.references(records(spark, sf)))


@query("Q8_exact", f"WITH {KEYS_SQL} SELECT run, kind, exact, count(*) AS size, min(seq) AS first FROM kr WHERE exact <> '' GROUP BY 1, 2, 3 HAVING count(*) > 1")
def q8(spark, sf):
    return kx.exact_groups(_rows(spark, sf))


def _labels(spark, sf):
    rows = _rows(spark, sf)
    verdicts = table(spark, sf, "pair_verdict")
    return rows, verdicts, kx.clusters(kx.duplicate_edges(rows, verdicts))


@query("Q9_clusters")
def q9(spark, sf):
    return _labels(spark, sf)[2]


@query("Q10_stats")
def q10(spark, sf):
    rows, verdicts, labels = _labels(spark, sf)
    return r6(kx.cluster_stats(labels, rows, verdicts), "avg_similarity")


@query("Q11_report")
def q11(spark, sf):
    rows, verdicts, labels = _labels(spark, sf)
    return r6(kx.duplication(rows, kx.cluster_stats(labels, rows, verdicts)), "duplication_rate")


@query("Q12_semantic", """WITH s AS (SELECT *, CASE WHEN both_empty THEN 1.0 ELSE score END AS s FROM semantic_verdict),
c AS (SELECT model, page, chunk, avg(s) AS s FROM s WHERE s IS NOT NULL GROUP BY 1, 2, 3) SELECT model, page, round(avg(s), 6) AS semantic FROM c GROUP BY 1, 2""")
def q12(spark, sf):
    return r6(kx.semantic_pages(table(spark, sf, "semantic_verdict")), "semantic")


def _page_scores(spark, sf):
    rows, verdicts, labels = _labels(spark, sf)
    dedup = kx.duplication(rows, kx.cluster_stats(labels, rows, verdicts))
    return kx.page_scores(_page_rows(spark, sf), kx.semantic_pages(table(spark, sf, "semantic_verdict")), dedup)


@query("Q13_scores")
def q13(spark, sf):
    out = _page_scores(spark, sf).select("model", "page", "f1", "content", "cross_ref", "semantic", "dedup_score", "error_score", "overall")
    return r6(out, "f1", "content", "cross_ref", "semantic", "dedup_score", "error_score", "overall")


@query("Q14_rank", """WITH s AS (SELECT dataset || model AS model, avg(wer) AS overall FROM asr_score GROUP BY 1)
SELECT model, round(overall, 6) AS overall, row_number() OVER (ORDER BY overall DESC, model) AS rank FROM s""")
def q14(spark, sf):
    s = table(spark, sf, "asr_score").groupBy(F.concat("dataset", "model").alias("model")).agg(F.avg("wer").alias("overall"))
    return r6(kx.rank_models(s), "overall")


@query("Q13_models")
def q13_models(spark, sf):
    out = kx.model_scores(_page_scores(spark, sf))
    return r6(out, *[c for c in out.columns if c not in ("model", "rank")])


STRIP = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\b[RE]V?\d{{2,4}}\b', '<ID>', 'g'), '\bRULE\d{{2,4}}\b', '<ID>', 'g'), '\bP\d{{2,4}}\b', '<ID>', 'g'), '  +', ' ', 'g')"


@query("Q15_flat", "SELECT run, page, idx, " + " || chr(10) || ".join(
    f"'    {f}: ' || " + STRIP.format(x=f"coalesce({f}, 'N/A')") for f in kx.SHOWN_FIELDS["krule"]) + " AS txt FROM krule")
def q15(spark, sf):
    k = records(spark, sf)["krule"]
    return k.select("run", "page", "idx", kx.flat_lines(k, "krule").alias("txt"))


@query("Q16_open", """SELECT doc_id AS unit, CASE WHEN doc_id % 3 = 0 THEN 'b' ELSE 'a' END AS cfg FROM documents WHERE NOT (doc_id % 4 = 0 AND doc_id % 3 <> 0)""")
def q16(spark, sf):
    d = table(spark, sf, "documents")
    cfg = F.when(F.col("doc_id") % 3 == 0, "b").otherwise("a")
    units = d.select(F.col("doc_id").alias("unit"), cfg.alias("cfg"), kx.config_hash(F.struct(cfg.alias("model"), F.lit(0.7).alias("threshold"))).alias("config_hash"))
    done = d.where("doc_id % 4 = 0").select(F.col("doc_id").alias("unit"), kx.config_hash(F.struct(F.lit("a").alias("model"), F.lit(0.7).alias("threshold"))).alias("config_hash"))
    return kx.open_units(units, done).select("unit", "cfg")
