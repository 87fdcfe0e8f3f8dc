"""License scans with a positional rare-token index, with built-in functions only.

Templates are short licence notices. The corpus tells how rare each of their words is; per template the rarest words are
indexed with their positions. Where indexed words stand in a text, each gives a template and the word at which that
template would begin; hits that agree on both are intersected, and a template counts if they carry enough of its rarity
and its mandatory key phrase stands at the aligned place. Only the rare words of a text, with the few words around them,
leave the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroscope.idioms import let
from aeroscope.llm.common import row_hash, saved

#: What separates words, once A-Z are lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    notice: str
    phrase: str

    def words(self) -> list[str]:
        return self.notice.split()

    def phrase_at(self) -> int:
        words, phrase = self.words(), self.phrase.split()
        return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


#: Opening words of public licence notices, and the phrase that must stand in each.
TEMPLATES = (
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    Template("cc0", "the person who associated a work with this deed has dedicated the work to the public domain", "dedicated the work to the public domain"),
)
#: Words indexed per template, and the share of their rarity that a match must carry.
RARE, ENOUGH = 4, 0.6


def words_of(text: Column) -> Column:
    """Words of a text, a null one being empty. A letter beyond ASCII may change case too, within its word."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), "")


def base_places(words: Column) -> Column:
    """Places of the base phrases: start word and label."""
    at = lambda i: F.get(words, i)
    ends = F.filter(F.sequence(F.lit(1), F.size(words) - 1), lambda i: (at(i) == "license") & (
        at(i - 1).isin("mit", "apache") | ((at(i - 1) == "public") & (F.get(words, i - 2) == "general"))
    ))
    place = lambda i: F.struct(
        F.when(at(i - 1) == "public", i - 2).otherwise(i - 1).alias("start"), F.when(at(i - 1) == "public", "gpl").otherwise(at(i - 1)).alias("label")
    )
    return F.transform(ends, place)


def index(df: DataFrame, text_col: str, templates: tuple[Template, ...], rare: int) -> list[tuple[str, int, int, float]]:
    """Postings (word, template, position, rarity) of each template's rarest words in the corpus.

    Counts documents for the templates' words only, so a bounded table comes to the driver. Rarity is the logarithm of
    the inverse share of documents; equal ones go by the word, and a word that repeats counts at its first position.
    """
    vocabulary = sorted({w for t in templates for w in t.words()})
    known = F.array(*map(F.lit, vocabulary))
    word = F.explode_outer(F.array_intersect(words_of(F.col(text_col)), known)).alias("word")
    seen = {r["word"]: r["n"] for r in df.select(word).groupBy("word").agg(F.count("*").alias("n")).collect()}
    total = df.count()
    idf = df.sparkSession.createDataFrame([(w, seen.get(w, 0)) for w in vocabulary], "word string, n long").select(
        "word", F.round(F.log((F.lit(total) + 1) / (F.col("n") + 1)) + 1, 9).alias("idf")
    )
    rarity = {r["word"]: r["idf"] for r in idf.collect()}
    return [
        (w, i, t.words().index(w), rarity[w])
        for i, t in enumerate(templates)
        for w in sorted(set(t.words()), key=lambda w: (-rarity[w], w))[:rare]
    ]


def scan(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, rare: int = RARE, enough: float = ENOUGH
) -> DataFrame:
    """One row per row of `df`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is the best share of rarity of a verified template, and at least one half where a base phrase stands.
    Null and empty texts have no words and no labels. Rows that are equal, or share an id, are scanned each for itself.
    An empty table gives no rows. Other columns of `df` are told apart but not returned.
    """
    spark = df.sparkSession
    postings = index(df, text_col, templates, rare)
    reach = max(len(t.words()) for t in templates)
    vocabulary = F.array(*map(F.lit, sorted({p[0] for p in postings})))
    no_places = F.array().cast("array<struct<start:int,label:string>>")
    no_hits = F.array().cast("array<struct<pos:int,word:string,around:array<string>>>")

    def hits(w: Column) -> Column:
        found = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.array_contains(vocabulary, F.get(w, i)))
        around = lambda i: F.slice(w, F.greatest(i - reach, F.lit(0)) + 1, 2 * reach + 1)
        return F.transform(found, lambda i: F.struct(i.alias("pos"), F.get(w, i).alias("word"), around(i).alias("around")))

    read = let(words_of(F.col(text_col)), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        F.when(F.array_contains(w, "license") & (F.size(w) > 1), base_places(w)).otherwise(no_places).alias("base"),
        F.when(F.arrays_overlap(w, vocabulary), hits(w)).otherwise(no_hits).alias("hits"),
    ))
    rows = df.select(F.col(id_col).alias("doc_id"), row_hash(df).alias("row"), read.alias("r"))
    rows = saved(rows.select("doc_id", "row", "r.*"), "license-words")
    table = spark.createDataFrame(
        [(w, t, at, idf, templates[t].phrase_at() - at, templates[t].phrase.split()) for w, t, at, idf in postings],
        "word string, template int, at int, idf double, phrase_from int, phrase array<string>",
    )
    total = {t: sum(p[3] for p in postings if p[1] == t) for t in range(len(templates))}
    of_template = spark.createDataFrame([(t, templates[t].label, total[t]) for t in total], "template int, label string, total double")
    found = rows.select("doc_id", "row", F.inline("hits")).join(F.broadcast(table), "word")  # `rare` rows per template
    begin = F.least("pos", F.lit(reach)) + F.col("phrase_from")  # of the phrase, in the words around
    verified = (begin >= 0) & (F.slice("around", F.greatest(begin, F.lit(0)) + 1, F.size("phrase")) == F.col("phrase"))
    aligned = found.select("doc_id", "row", "template", (F.col("pos") - F.col("at")).alias("begin"), F.struct("at", "idf").alias("hit"), verified.alias("ok"))
    aligned = aligned.groupBy("doc_id", "row", "template", "begin").agg(F.collect_set("hit").alias("hits"), F.bool_or("ok").alias("ok")).where("ok")
    share = F.round(F.aggregate("hits", F.lit(0.0), lambda a, h: a + h["idf"]) / F.col("total"), 6)
    matched = aligned.join(F.broadcast(of_template), "template").withColumn("share", share).where(F.col("share") >= enough)
    matched = matched.groupBy("doc_id", "row").agg(F.collect_set("label").alias("own"), F.max("share").alias("best"))
    l, r = rows.alias("l"), matched.alias("r")
    joined = l.join(r, (F.col("l.row") == F.col("r.row")) & F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")), "left")
    base_labels = F.array_sort(F.array_distinct(F.col("base.label")))
    own = F.coalesce("own", F.array().cast("array<string>"))
    return joined.select(
        "l.doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min("base.start").cast("bigint").alias("first_word"), F.array_max("base.start").cast("bigint").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base_labels, own)), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
