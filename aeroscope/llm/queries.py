"""One query per operator, with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroscope.llm import chat, divergence, licenses, lines, media, mixing, packing, quality, simhash, suffixes, token_files, tokens, toxicity, variants
from aeroscope.llm.common import table
from aeroscope.llm.registry import query

#: Shares of the production mix: the dominant source is held at a fifth.
MIX_SHARES = {"src0": 20, **{f"src{i}": 4 for i in range(1, 20)}, mixing.REST: 4}
MIX_BLOCK = 4

_SHARES_SQL = ", ".join(f"('{s}', {n})" for s, n in MIX_SHARES.items())


@query("op7_mixing", f"""WITH RECURSIVE shares(k, n) AS (VALUES {_SHARES_SQL}),
d AS (SELECT doc_id, CASE WHEN source IN (SELECT k FROM shares) THEN source ELSE '*' END AS k FROM documents),
r AS (SELECT doc_id, k, (row_number() OVER (PARTITION BY k ORDER BY md5(doc_id::VARCHAR), doc_id) - 1) // {MIX_BLOCK} AS b FROM d),
c AS (SELECT k, n, count(*) // {MIX_BLOCK} AS full_blocks, row_number() OVER (ORDER BY k) AS i FROM d JOIN shares USING (k) GROUP BY k, n),
q AS (SELECT sum(n)::BIGINT AS q, list(n::BIGINT ORDER BY i) AS n FROM c),
edf AS (
  SELECT 0::BIGINT AS t, list_transform(n, lambda x: 0::BIGINT) AS nxt, 0::BIGINT AS pick, 0::BIGINT AS j FROM q
  UNION ALL
  SELECT t + 1, list_transform(range(1, len(nxt) + 1), lambda i: nxt[i] + CASE WHEN i = p.best.i THEN 1 ELSE 0 END), p.best.i, nxt[p.best.i]
  FROM (SELECT t, nxt, q.q AS q, list_sort(list_transform(
      list_filter(range(1, len(nxt) + 1), lambda i: nxt[i] < q.n[i] AND nxt[i] * q.q // q.n[i] <= t),
      lambda i: {{'d': ((nxt[i] + 1) * q.q + q.n[i] - 1) // q.n[i], 'i': i}}))[1] AS best FROM edf, q) p WHERE t < p.q),
s AS (SELECT c.k, c.n, c.full_blocks, q.q, edf.j, edf.t - 1 AS t FROM edf JOIN c ON c.i = edf.pick, q WHERE edf.t > 0),
h AS (SELECT min(full_blocks // n * q + t) AS stop FROM s WHERE j = full_blocks % n)
SELECT doc_id, r.k AS source, b AS block, b // n * q + j * q // n AS release, b // n * q + ((j + 1) * q + n - 1) // n AS deadline,
 b // n * q + t AS slot, coalesce(b // n * q + t < (SELECT stop FROM h), false) AS in_mix
FROM r LEFT JOIN s ON r.k = s.k AND r.b % s.n = s.j""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), MIX_SHARES, MIX_BLOCK, columns=["doc_id"])
    return mixed.select("row.doc_id", *mixed.columns[1:])


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens.vocabulary_path())


@query("op4_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *quality.SIGNALS[:5], "base_failed", "kept", "posterior")


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.judge(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op8_line_dedup", f"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, s, 2 AS n, ls[s + 1] || chr(10) || ls[s + 2] AS k FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 1)) AS s FROM l)
  UNION ALL SELECT doc_id, s, 1, k FROM (SELECT doc_id, unnest(range(0, len(ls))) AS s, unnest(ls) AS k FROM l)
  WHERE length(k) >= {lines.LONG_CHARS} OR len(regexp_extract_all(k, '[^\\x20\\x09-\\x0D]+')) >= {lines.LONG_WORDS}),
n AS (SELECT doc_id, s, n, row_number() OVER (PARTITION BY n, k ORDER BY doc_id, s) AS nth FROM w WHERE regexp_matches(k, '[^\\x20\\x09-\\x0D]')),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS i FROM n WHERE nth > 1),
g AS (SELECT doc_id, list(i ORDER BY i) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, len(ls)::INT AS n_lines, coalesce(len(gone), 0)::INT AS n_removed,
 coalesce(len(list_filter(gone, lambda x: NOT list_contains(gone, x - 1))), 0)::INT AS n_runs,
 sha256(array_to_string(list_filter(ls, lambda x, i: gone IS NULL OR NOT list_contains(gone, i - 1)), chr(10))) AS kept_sha256
FROM l LEFT JOIN g USING (doc_id)""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("n_lines", F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)
    spans = F.coalesce("_spans", F.array().cast("array<struct<first:int,last:int>>"))
    return lines.dedup_lines(docs).select(
        "doc_id", "n_lines", F.aggregate(spans, F.lit(0), lambda n, s: n + s["last"] - s["first"] + 1).alias("n_removed"),
        F.size(spans).alias("n_runs"), F.sha2("text", 256).alias("kept_sha256"),
    )


@query("op1_media")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.through_archives(table(spark, sf_dir, "documents"))


_TEMPLATES_SQL = ", ".join(
    f"({i}, '{t.label}', '{t.notice}', '{t.phrase}', {t.phrase_at()})" for i, t in enumerate(licenses.TEMPLATES)
)


@query("op9_license_scan", f"""WITH t(i, label, notice, phrase, phrase_at) AS (VALUES {_TEMPLATES_SQL}),
tw AS (SELECT i, w, min(p) AS tp FROM (SELECT i, unnest(string_split(notice, ' ')) AS w, generate_subscripts(string_split(notice, ' '), 1) - 1 AS p FROM t) GROUP BY i, w),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM d),
f AS (SELECT w, count(DISTINCT doc_id) AS n FROM w WHERE w IN (SELECT w FROM tw) GROUP BY w),
idf AS (SELECT w, round(ln(((SELECT count(*) FROM documents) + 1) / (coalesce(n, 0) + 1)) + 1, 9) AS r FROM (SELECT DISTINCT w FROM tw) LEFT JOIN f USING (w)),
ix AS (SELECT i, w, tp, r FROM tw JOIN idf USING (w) QUALIFY row_number() OVER (PARTITION BY i ORDER BY r DESC, w) <= {licenses.RARE}),
tot AS (SELECT i, sum(r) AS total FROM ix GROUP BY i),
hit AS (SELECT doc_id, i, p - tp AS b, sum(r) AS s FROM w JOIN ix USING (w) GROUP BY ALL),
v AS (SELECT doc_id, label, round(s / total, 6) AS share FROM hit JOIN tot USING (i) JOIN t USING (i) JOIN d USING (doc_id)
  WHERE b + phrase_at >= 0 AND ws[b + phrase_at + 1 : b + phrase_at + len(string_split(phrase, ' '))] = string_split(phrase, ' ')),
m AS (SELECT doc_id, list(DISTINCT label) AS own, max(share) AS best FROM v WHERE share >= {licenses.ENOUGH} GROUP BY doc_id),
bp AS (SELECT doc_id, CASE WHEN ws[p] = 'public' THEN p - 2 ELSE p - 1 END AS start, CASE WHEN ws[p] = 'public' THEN 'gpl' ELSE ws[p] END AS label
  FROM w JOIN d USING (doc_id) WHERE w = 'license' AND p >= 1 AND (ws[p] IN ('mit', 'apache') OR (p >= 2 AND ws[p] = 'public' AND ws[p - 1] = 'general'))),
b AS (SELECT doc_id, count(*) AS n, min(start) AS lo, max(start) AS hi, list_sort(list(DISTINCT label)) AS ls FROM bp GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(array_to_string(ls, ','), '') AS base_labels,
 array_to_string(list_sort(list_distinct(coalesce(ls, []) || coalesce(own, []))), ',') AS labels,
 greatest(coalesce(best, 0), CASE WHEN n > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op5_chat", """WITH s AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, speaker, text) - 1 AS place FROM s),
w AS (SELECT DISTINCT conv_id, speaker AS perspective FROM s WHERE speaker NOT IN ('system', 'tool')),
r AS (SELECT p.conv_id, perspective, place, turn, text,
  CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker IN ('system', 'tool') THEN speaker ELSE 'user' END AS role,
  CASE WHEN speaker <> perspective AND speaker NOT IN ('system', 'tool') THEN speaker END AS name FROM p JOIN w ON p.conv_id IS NOT DISTINCT FROM w.conv_id),
m AS (SELECT *, '<|im_start|>' || role || CASE WHEN name IS NULL THEN '' ELSE ' name=' || name END || chr(10) || text || '<|im_end|>' || chr(10) AS rendered FROM r),
e AS (SELECT *, (sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY place))::BIGINT AS "end" FROM m)
SELECT conv_id, perspective, place, turn, role, name, rendered, "end" - length(rendered) AS start, "end",
 CASE WHEN role = 'assistant' THEN "end" - length(text) - 11 END AS mask_start, CASE WHEN role = 'assistant' THEN "end" END AS mask_end FROM e""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


@query("op6_suffix_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


@query("op13_token_files")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.through_files(table(spark, sf_dir, "documents"), tokens.vocabulary_path())


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op11_source_divergence", f"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
w AS (SELECT i, lang, source, unnest(ws) AS w FROM d),
k AS (SELECT lang, w, count(*) AS total FROM w GROUP BY lang, w HAVING count(DISTINCT i) >= {divergence.LEAST}),
l AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS size FROM k GROUP BY lang),
c AS (SELECT lang, source, w, count(*) AS n FROM w SEMI JOIN k USING (lang, w) GROUP BY lang, source, w),
g AS (SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS size FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.w, coalesce(c.n, 0) AS n, 1 + {divergence.UNIT} * (coalesce(c.n, 0) + 2) // (g.size + 2 * l.v) AS p,
  1 + {divergence.UNIT} * (k.total + 2) // (l.size + 2 * l.v) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN l ON g.lang = l.lang LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.w = c.w),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.w = b.w AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', w, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM r
QUALIFY part = 'pair' OR rank <= {divergence.TOP}""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op12_spelling_variants", f"""WITH crcs AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS id, unnest(list_filter(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]+'),
  lambda x: length(x) >= {variants.CHARS})) AS run FROM documents),
r AS (SELECT run, id || run AS keyed, hex(encode(id || run)) AS bytes, count(*) AS n FROM d GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(bytes) // 2), lambda i: ('0x' || substr(bytes, 2 * i + 1, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM r, crcs),
c AS (SELECT CASE WHEN h % {variants.EVERY} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM c WHERE length(word) >= {variants.CHARS} GROUP BY word HAVING sum(n) >= {variants.COUNT}),
x AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS cut FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
e AS (SELECT a.word, b.word AS near FROM x a JOIN x b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, w.word FROM x JOIN w ON x.cut = w.word UNION SELECT w.word, x.word FROM x JOIN w ON x.cut = w.word),
b AS (SELECT e.word, count(*) AS n_near, max(n) AS most, arg_max(near, n) AS any_best FROM e JOIN w ON w.word = e.near GROUP BY e.word),
f AS (SELECT b.word, b.n_near, b.most, min(e.near) AS best FROM b JOIN e USING (word) JOIN w ON w.word = e.near AND w.n = b.most GROUP BY ALL),
g AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {variants.RATIO} * w.n THEN best END AS form, CASE WHEN most >= {variants.RATIO} * w.n THEN most END AS form_n
  FROM w LEFT JOIN f USING (word)),
s AS (WITH RECURSIVE z AS (SELECT word, word AS root, 0 AS step FROM g UNION ALL SELECT z.word, g.form, step + 1 FROM z JOIN g ON g.word = z.root WHERE g.form IS NOT NULL)
  SELECT word, arg_max(root, step) AS root FROM z GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM g JOIN s USING (word)""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))
