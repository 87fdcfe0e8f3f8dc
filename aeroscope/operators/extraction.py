"""Extracted records: cleaning, first-wins accumulation, context selection, identifiers and chunks.

Record tables carry run, page, chunk, idx; their order is (page, chunk, idx).
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeroscope.idioms import carry, latest, running, top_k_cosine

# Record types in processing order, their id prefixes, and the prefix each reference needs.
PREFIXES = {"entity": "E", "relationship": "R", "event": "EV", "krule": "RULE", "procedure": "P"}
ITEM_NAMES = {"entity": "entity", "relationship": "relationship", "event": "event", "krule": "rule", "procedure": "procedure"}
REFERENCES = {
    "entity": {},
    "relationship": {"subject_id": "E", "object_id": "E"},
    "event": {"actors": "E", "targets": "E"},
    "krule": {
        "trigger_entities": "E", "action_entities": "E", "linked_entities": "E", "linked_relationships": "R",
    },
    "procedure": {"linked_rules": "RULE"},
}
# Context limits per type and similarity threshold.
CONTEXT_LIMITS = {"entity": 50, "krule": 5, "relationship": 10, "event": 5, "procedure": 5}
CONTEXT_THRESHOLD = 0.1

PLACE = ("run", "page", "chunk")


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def bad_refs(df: DataFrame, field: str, prefix: str) -> Column:
    """References of one field without the expected prefix; a missing field is fine, an empty text is not."""
    if dict(df.dtypes)[field].startswith("array"):
        refs = F.col(field)
    else:
        refs = F.when(F.col(field).isNotNull(), F.array(field))
    empty = F.array().cast("array<string>")
    return F.coalesce(F.filter(refs, lambda r: ~F.coalesce(r.startswith(prefix), F.lit(False))), empty)


def reference_errors(df: DataFrame, kind: str) -> DataFrame:
    """One row per record and field that holds references with a wrong prefix."""
    found = [
        F.struct(F.lit(f).alias("field"), F.array_join(bad_refs(df, f, p), ",").alias("values"), (F.size(bad_refs(df, f, p)) > 0).alias("bad"))
        for f, p in REFERENCES[kind].items()
    ]
    return df.withColumn("e", F.explode(F.filter(F.array(*found), lambda e: e["bad"]))).select(
        *PLACE, "idx", "id", "e.field", "e.values"
    )


def _marked(df: DataFrame, kind: str) -> DataFrame:
    """Flags of one record that do not depend on other records."""
    prefix = PREFIXES[kind]
    rows = df.withColumn("raw_id", F.col("id"))
    if kind == "entity":
        # a bare number gets its prefix back
        rows = rows.withColumn("id", F.when(F.col("id").rlike(r"^\d+$"), F.concat(F.lit("E"), "id")).otherwise(F.col("id")))
        corrupt = F.coalesce(F.col("text") == F.col("id"), F.lit(False))
    else:
        corrupt = F.lit(False)
    refs_ok = F.lit(True)
    for field, p in REFERENCES[kind].items():
        refs_ok = refs_ok & (F.size(bad_refs(df, field, p)) == 0)
    return rows.withColumns(
        {
            "missing": blank(F.col("id")),
            "prefix_ok": F.coalesce(F.col("id").startswith(prefix), F.lit(False)),
            "corrupt": corrupt,
            "refs_ok": refs_ok,
            "pos": F.struct(F.lit(list(PREFIXES).index(kind)).alias("kind"), "idx"),
        }
    )


def clean(records: Mapping[str, DataFrame], strict: bool = True) -> tuple[dict[str, DataFrame], DataFrame]:
    """Kept records per type and one table of errors.

    Within a chunk the first valid record of an id wins over all types; records without an id are split off
    before the join, so an empty id never forms a hot key.
    """
    marked = {k: _marked(df, k) for k, df in records.items()}

    def valid(kind: str) -> Column:
        ok = ~F.col("missing") & F.col("prefix_ok") & ~F.col("corrupt")
        return ok & F.col("refs_ok") if strict else ok

    firsts = reduce(
        DataFrame.unionByName,
        [m.where(valid(k)).select(*PLACE, "id", "pos") for k, m in marked.items()],
    ).groupBy(*PLACE, "id").agg(F.min("pos").alias("first_pos"))

    kept, errors = {}, []
    for kind, m in marked.items():
        named = m.where(~F.col("missing")).join(firsts, [*PLACE, "id"], "left")
        dup = F.coalesce(F.col("pos") > F.col("first_pos"), F.lit(False))
        prefix_ok, corrupt = F.col("prefix_ok"), F.col("corrupt")
        fresh = prefix_ok & ~dup & ~corrupt
        name = ITEM_NAMES[kind]
        checks = [("duplicate_id", name, None, prefix_ok & dup)]
        if kind == "entity":
            context, nulls = F.col("context"), F.col("formal_definition").isin("N/A", "None", "")
            checks += [
                ("wrong_prefix", name, None, ~F.col("raw_id").startswith("E")),
                ("corrupt_entity", name, None, prefix_ok & ~dup & corrupt),
                ("empty_context", name, None, fresh & (blank(context) | context.isin("N/A", "None"))),
                ("normalized_field", name, None, fresh & F.coalesce(nulls, F.lit(False))),
            ]
            live = named.where(fresh).withColumn("formal_definition", F.when(~nulls, F.col("formal_definition")))
            errors.append(_errors(m.where("missing"), name, [("missing_id", name, None, F.lit(True))]))
        else:
            checks.append(("wrong_prefix", name, None, ~prefix_ok))
            checks += [
                ("invalid_cross_reference", "unknown", f, fresh & (F.size(bad_refs(records[kind], f, p)) > 0))
                for f, p in REFERENCES[kind].items()
            ]
            live = named.where(fresh & F.col("refs_ok")) if strict else named.where(fresh)
        errors.append(_errors(named, name, checks))
        kept[kind] = live.select(*records[kind].columns)
    return kept, reduce(DataFrame.unionByName, errors)


def _errors(rows: DataFrame, record_type: str, checks: list[tuple[str, str, str | None, Column]]) -> DataFrame:
    """All errors of a record in one pass."""
    found = [
        F.when(
            cond,
            F.struct(
                F.lit(item_type).alias("item_type"), F.lit(type_).alias("type"),
                F.lit(field).cast("string").alias("field"),
            ),
        )
        for type_, item_type, field, cond in checks
    ]
    return rows.withColumn("e", F.explode(F.array_compact(F.array(*found)))).select(
        *PLACE, "idx", F.lit(record_type).alias("record_type"), "e.item_type", F.col("raw_id").alias("item_id"),
        "e.type", "e.field",
    )


def error_summary(errors: DataFrame) -> DataFrame:
    """Counts per page by error type and by record type."""
    return errors.groupingSets([["run", "page", "type"], ["run", "page", "item_type"]], "run", "page", "type", "item_type").agg(
        F.count("*").alias("n")
    )


def failure_rows(attempts: DataFrame) -> DataFrame:
    """Error rows of chunks whose extraction failed, and warnings for steps that failed in a kept chunk.

    attempts: run, page, chunk, ok, step (null: no step failed), step_num, message.
    """
    step = F.col("step").isNotNull()
    text = F.format_string("Step %d (%s)", "step_num", "step")
    message = (
        F.when(~F.col("ok") & step, F.concat(text, F.lit(" failed: "), "message"))
        .when(~F.col("ok"), "KEX extraction failed after all retries (see raw_llm_output for details)")
        .otherwise(F.concat(text, F.lit(" had errors but extraction continued")))
    )
    return attempts.where(~F.col("ok") | step).select(
        *PLACE, F.lit("extraction_failed").alias("type"), F.lit("chunk").alias("item_type"), "step", "step_num",
        F.when(F.col("ok"), "warning").alias("severity"), message.alias("message"),
    )


def contract_breaks(records: Mapping[str, DataFrame]) -> DataFrame:
    """Record contract per chunk: ids unique over all types, prefixes, context not blank."""
    ids = reduce(
        DataFrame.unionByName,
        [df.select(*PLACE, F.lit(k).alias("kind"), "idx", "id") for k, df in records.items()],
    )
    repeated = ids.where(~blank(F.col("id"))).groupBy(*PLACE, "id").agg(F.count("*").alias("n")).where("n > 1")
    dup = repeated.select(*PLACE, "id", F.lit("duplicate_id").alias("rule"), "n")
    expected = F.element_at(F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv]), F.col("kind"))
    prefix = (
        ids.where(~F.coalesce(F.startswith(F.col("id"), expected), F.lit(False)))
        .groupBy(*PLACE, "id").agg(F.count("*").alias("n"))
        .select(*PLACE, "id", F.lit("wrong_prefix").alias("rule"), "n")
    )
    text = F.lower(F.trim(F.coalesce("context", F.lit(""))))
    context = (
        records["entity"].where(text.isin("", "n/a", "none"))
        .groupBy(*PLACE, "id").agg(F.count("*").alias("n"))
        .select(*PLACE, "id", F.lit("blank_context").alias("rule"), "n")
    )
    return dup.unionByName(prefix).unionByName(context)


def store_key(kind: str) -> Column:
    """Key that decides whether a record is already known, lower case and trimmed."""
    def c(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    raw = {
        "entity": c("text") if kind == "entity" else None,
        "krule": F.concat(c("rule_type"), F.lit(":"), c("trigger_text")),
        "relationship": F.concat(c("subject_text"), F.lit(":"), c("predicate"), F.lit(":"), c("object_text")),
        "event": F.concat(c("event_type"), F.lit(":"), c("trigger_text")),
        "procedure": c("name"),
    }[kind]
    return F.trim(F.lower(raw))


def accumulate(df: DataFrame, kind: str, by: Sequence[str] = ("run",)) -> DataFrame:
    """First record per key in (page, chunk, idx) order; empty keys are dropped."""
    keyed = df.withColumn("key", store_key(kind)).where(F.col("key") != "")
    return latest(keyed, [*by, "key"], ["page", "chunk", "idx"], keep="first")


def entity_catalogue(entities: DataFrame) -> DataFrame:
    """First text per normalised text over all pages, with the file it came from."""
    first = accumulate(entities, "entity")
    file = F.concat(F.lit("pagina_"), F.col("page").cast("int").cast("string"), F.lit(".json"))
    if "source_file" in entities.columns:
        file = F.col("source_file")
    return first.select(
        "run", "key", "text", F.coalesce("label", F.lit("Unknown")).alias("label"),
        F.coalesce("context", F.lit("")).alias("context"), file.alias("source_file"),
    )


def embed_text(kind: str) -> Column:
    """Text to embed, non-empty parts joined with ' | '."""
    def part(prefix: str, name: str) -> Column:
        return F.when(~blank(F.col(name)), F.concat(F.lit(prefix), F.col(name)))

    if kind == "entity":
        parts = [part("", "text"), part("type: ", "label"), part("subtype: ", "subtype"), part("context: ", "context")]
    elif kind == "krule":
        parts = [
            part("type: ", "rule_type"), part("modality: ", "modality"), part("trigger: ", "trigger_text"),
            part("constraint: ", "constraint_text"), part("purpose: ", "explainability"),
        ]
    elif kind == "relationship":
        whole = ~blank(F.col("subject_text")) & ~blank(F.col("predicate")) & ~blank(F.col("object_text"))
        parts = [
            F.when(whole, F.concat_ws(" ", "subject_text", "predicate", "object_text")), part("type: ", "relation_type"),
        ]
    elif kind == "event":
        parts = [
            part("type: ", "event_type"), part("trigger: ", "trigger_text"), part("phase: ", "phase"),
            part("when: ", "temporal_context"),
        ]
    else:
        parts = [part("name: ", "name"), part("purpose: ", "purpose"), part("context: ", "context")]
    return F.trim(F.concat_ws(" | ", *parts))


def entity_aliases_part() -> Column:
    """Optional alias part of the entity text."""
    return F.when(F.size("aliases") > 0, F.concat(F.lit("aliases: "), F.array_join("aliases", " ")))


def top_context(
    queries: DataFrame, items: DataFrame, top_k: int, threshold: float = CONTEXT_THRESHOLD
) -> DataFrame:
    """Items most like each query, best k first, then the threshold."""
    return top_k_cosine(queries, items, top_k).where(F.col("score") >= threshold)


def context_by_type(
    queries: DataFrame, items: DataFrame, limits: Mapping[str, int] = CONTEXT_LIMITS,
    threshold: float = CONTEXT_THRESHOLD,
) -> DataFrame:
    """Per record type (column grp) the best items seen before the query."""
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("grp"))
    return top_k_cosine(queries, items, limit, before=True).where(F.col("score") >= threshold)


def last_ids(df: DataFrame, prefix: str) -> DataFrame:
    """Last id per run as the tracker keeps it (highest of the latest batch that had one), the true highest
    id, and the hint for the next one."""
    number = F.regexp_extract("id", rf"^{prefix}(\d+)$", 1).try_cast("bigint")
    per_batch = (
        df.withColumn("num", number).where(F.col("num") > 0)
        .groupBy("run", "page", "chunk").agg(F.max("num").alias("num"))
    )
    name = lambda c: F.concat(F.lit(prefix), F.format_string("%03d", c))
    return per_batch.groupBy("run").agg(
        F.max_by("num", F.struct("page", "chunk")).alias("last"), F.max("num").alias("top")
    ).select(
        "run", name(F.col("last")).alias("last_id"), name(F.col("top")).alias("max_id"),
        name(F.col("last") + 1).alias("next_hint"),
    )


def resume_window(pages: DataFrame, start: float, final: float | None = None) -> DataFrame:
    """Pages before the start only feed context, later ones are processed, pages past the end drop out."""
    inside = F.lit(True) if final is None else F.col("page") <= final
    return pages.where(inside).withColumn("role", F.when(F.col("page") < start, "context").otherwise("process"))


def segments(text: Column, granularity: str) -> Column:
    """Pieces of a page: whole page, sentences, or non-empty lines."""
    if granularity == "page":
        return F.array(text)
    if granularity == "sentence":
        parts = F.split(text, r"(?<=[.!?])\s+")
    else:
        parts = F.split(text, "\n")
    return F.filter(F.transform(parts, lambda t: F.trim(t)), lambda s: s != "")


def range_errors(ranges: DataFrame) -> DataFrame:
    """Why the logical ranges of a page do not cover its lines; null when they do.

    ranges: run, page, start, end, n_lines, has_context. A page has few ranges; they are combined per page
    as one sorted array, so no window is needed.
    """
    pages = ranges.groupBy("run", "page").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("r"),
        F.max("n_lines").alias("n_lines"), F.max("has_context").alias("has_context"),
    )
    first = F.when(F.col("has_context"), -1).otherwise(0)
    gaps = F.exists(
        F.sequence(F.lit(1), F.size("r")),
        lambda i: (i > 1) & (F.element_at("r", i)["start"] != F.element_at("r", F.greatest(i - 1, F.lit(1)))["end"] + 1),
    )
    error = (
        F.when(F.exists("r", lambda x: (x["start"] < -1) | (x["end"] < -1)), "index below -1")
        .when(F.exists("r", lambda x: x["start"] > x["end"]), "start after end")
        .when(F.element_at("r", 1)["start"] != first, "wrong first index")
        .when(F.element_at("r", -1)["end"] != F.col("n_lines") - 1, "wrong last index")
        .when(gaps, "gap")
    )
    return pages.select("run", "page", error.alias("error"))


def chunk_texts(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Chunk texts from line ranges; a range from -1 starts with the text carried from the page before.

    pages: run, page, lines array, carried (null on the first page).
    """
    start = F.col("start")
    own = F.slice("lines", F.greatest(start, F.lit(0)) + 1, F.greatest(F.col("end") - F.greatest(start, F.lit(0)) + 1, F.lit(0)))
    text = F.when(start == -1, F.array_join(F.concat(F.array("carried"), own), " ")).otherwise(F.array_join(own, " "))
    return ranges.join(pages, ["run", "page"]).select("run", "page", "start", "end", text.alias("text"))


def carry_last(chunks: DataFrame, next_page: Column | None = None) -> DataFrame:
    """Mark the chunk that moves on to the next page and whether each chunk stays in the saved output.

    chunks: run, page, chunk, text, external. The last chunk is dropped from a generated page unless the page
    is the last one or has a single chunk. Aggregates per page and per run replace windows over all chunks.
    """
    per_page = chunks.groupBy("run", "page").agg(F.max("chunk").alias("last_chunk"), F.count("*").alias("n_chunks"))
    per_run = per_page.groupBy("run").agg(F.max("page").alias("last_page"))
    joined = chunks.join(per_page, ["run", "page"]).join(per_run, "run")
    is_last = F.col("chunk") == F.col("last_chunk")
    return joined.select(
        *chunks.columns, is_last.alias("carried"),
        (~(is_last & ~F.col("external") & (F.col("page") != F.col("last_page")) & (F.col("n_chunks") > 1))).alias("saved"),
    )


def carried_text(chunks: DataFrame, block: int = 100_000) -> DataFrame:
    """Text carried into each page: the last chunk of the page before it, found block by block of page numbers."""
    last = chunks.groupBy("run", "page").agg(F.max_by("text", "chunk").alias("text"))
    found = carry(last, ["run"], "page", {"previous": F.struct("text")}, block, before=True)
    return found.select("run", "page", F.col("previous.text").alias("carried"))


def prefer_external(pages: DataFrame, external: DataFrame) -> DataFrame:
    """External chunks replace the page text; sub-pages that only exist outside are added."""
    has = external.select("page").distinct().withColumn("ext", F.lit(True))
    own = pages.join(has, "page", "left").select(
        "page", F.when(F.col("ext"), "").otherwise(F.col("text")).alias("text"), F.coalesce("ext", F.lit(False)).alias("external")
    )
    extra = has.where(F.col("page") != F.floor("page")).select("page", F.lit("").alias("text"), F.lit(True).alias("external"))
    return own.unionByName(extra.join(own.select("page"), "page", "left_anti"))


def chunk_audit(accumulated: Mapping[str, DataFrame], chunks: DataFrame) -> DataFrame:
    """Per chunk the totals of known records so far, in (page, chunk) order.

    New records are counted per chunk first; sums run over the chunks of a page, and over one row per page.
    """
    marks = []
    for kind, df in accumulated.items():
        marks.append(df.groupBy("run", "page", "chunk").agg(F.count("*").alias("c")).withColumn("kind", F.lit(kind)))
    per_chunk = reduce(DataFrame.unionByName, marks).groupBy("run", "page", "chunk").pivot("kind", list(accumulated)).agg(F.sum("c"))
    rows = chunks.join(per_chunk, ["run", "page", "chunk"], "left").na.fill(0, list(accumulated))
    before = Window.partitionBy("run").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    pages = rows.groupBy("run", "page").agg(*[F.sum(k).alias(k) for k in accumulated])
    pages = pages.select("run", "page", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_before") for k in accumulated])
    upto = Window.partitionBy("run", "page").orderBy("chunk")
    inside = rows.select("run", "page", "chunk", *[F.sum(k).over(upto).alias(f"{k}_upto") for k in accumulated])
    return inside.join(pages, ["run", "page"]).select(
        "run", "page", "chunk", *[(F.col(f"{k}_before") + F.col(f"{k}_upto")).alias(f"{k}_total") for k in accumulated]
    )


def run_totals(records: Mapping[str, DataFrame]) -> DataFrame:
    """Pages, chunks and records per run."""
    rows = reduce(
        DataFrame.unionByName,
        [df.groupBy("run", "page", "chunk").agg(F.count("*").alias("c")).withColumn("kind", F.lit(k)) for k, df in records.items()],
    )
    return rows.groupBy("run").agg(
        F.count_distinct("page").alias("pages"), F.count_distinct("page", "chunk").alias("chunks"),
        *[F.sum(F.when(F.col("kind") == k, F.col("c")).otherwise(0)).alias(k) for k in records],
    )


FENCED = r"(?s)```(?:json)?\s*\n(.*?)\n\s*```"


def is_json_value(text: Column) -> Column:
    """True for a text that parses to a JSON value other than an empty, zero, false or null one."""
    bare = F.regexp_replace(text, r"\s+", "")
    parsed = F.try_parse_json(text)
    return parsed.isNotNull() & ~bare.isin("{}", "[]", "null", "false", '""', "0", "0.0")


def first_json(text: Column) -> Column:
    """First valid JSON in a model answer: fenced blocks first, then balanced braces."""
    fenced = F.transform(F.regexp_extract_all(text, F.lit(FENCED), F.lit(1)), lambda t: F.trim(t))
    in_fence = F.try_element_at(F.filter(fenced, is_json_value), F.lit(1))
    return F.coalesce(in_fence, _first_balanced(text))


def _first_balanced(text: Column) -> Column:
    """First balanced {...} from the left that parses. Strings in either quote hide braces, as seen from its first brace."""
    return F.when(text.contains("{"), _scan_texts(text))


@F.pandas_udf(T.StringType())
def _scan_texts(texts: pd.Series) -> pd.Series:
    return texts.map(_scan_balanced)


SPECIAL = re.compile(r"[\"'\\{}]")


def _merge(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    """Two stacks of open braces from now on closed by the same braces: levels meet from the top."""
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    for k in range(1, len(short) + 1):
        many, few = (long[-k], short[-k]) if len(long[-k]) >= len(short[-k]) else (short[-k], long[-k])
        many += few
        long[-k] = many
    return long


def balanced_spans(text: str) -> list[tuple[int, int]]:
    """(first, last) of each opening brace and the brace that closes it, in order of the first, in one pass.

    Whether a brace counts depends on the quotes since the opening one. Readers that began at different braces and
    are in the same state (outside, in double quotes, in single quotes) go on alike, so one stack per state holds them
    all; where a quote brings two states together, their stacks are merged.
    """
    out_, dq, sq = [], [], []  # stacks of levels; a level has the starts that its closing brace ends
    escaped, at, spans = None, -1, []  # stacks that skip the character at `at`
    for m in SPECIAL.finditer(text):
        pos, c = m.start(), m.group()
        skipping = escaped if pos == at else None
        if escaped and not skipping:
            dq, sq = _merge(dq, escaped[0]), _merge(sq, escaped[1])
        escaped = None
        if c == '"':
            out_, dq = dq, out_
        elif c == "'":
            out_, sq = sq, out_
        elif c == "{":
            out_.append([pos])
        elif c == "}":
            if out_:
                spans += [(p, pos) for p in out_.pop()]
        elif dq or sq:
            escaped, at, dq, sq = (dq, sq), pos + 1, [], []
        if skipping:
            dq, sq = _merge(dq, skipping[0]), _merge(sq, skipping[1])
    return sorted(spans)


def _scan_balanced(text: str | None) -> str | None:
    for first, last in balanced_spans(text or ""):
        if not MEMBER.match(text, first):  # can't be an object with members
            continue
        try:
            if last - first < first:  # an error message looks at all that stands before it
                end = first + DECODER.raw_decode(text[first : last + 1])[1]
            else:
                end = DECODER.raw_decode(text, first)[1]
        except (ValueError, RecursionError):
            continue
        if end == last + 1:
            return text[first:end]
    return None


DECODER = json.JSONDecoder()
MEMBER = re.compile(r'\{[ \t\n\r]*"')
