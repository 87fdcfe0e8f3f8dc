"""Line dedup by winnowing, with built-in functions only.

Lines are hashed; of each window of `run` lines the one with the smallest hash (the last of equals) is selected, so any
two equal runs of `run` lines or more select the same line of theirs. Selected hashes that occur once are dropped. The
others are positions to match at: from each, the windows that selected it are extended to both sides and verified by
two 64-bit hashes of their whole text. The first position of every window text stays, later ones are deleted; a longer
repeated run is the union of its windows. Positions of a hot line are never paired with each other: each is compared
with the first one of its own window text, which a combining aggregate finds. A long line is a window of its
own, which selects itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroscope.idioms import let
from aeroscope.llm.common import quoted, row_hash, saved, unused

#: Shortest run of lines that is deleted where it repeats; the winnowing window.
RUN = 2
#: Words, or characters for scripts without spaces, from which one line is deleted where it repeats alone.
LONG_WORDS, LONG_CHARS = 20, 120
WORD = r"[^\x20\x09-\x0D]"


def is_long(line: Column, words: int) -> Column:
    """Whether a line has `words` words or LONG_CHARS characters, a word among them."""
    some = rf"^[\x20\x09-\x0D]*+(?:{WORD}++[\x20\x09-\x0D]++){{{words - 1}}}{WORD}"
    return ((F.length(line) >= LONG_CHARS) & line.rlike(WORD)) | line.rlike(some)


def windows(text: Column, run: int, long_words: int | None) -> Column:
    """Windows of `run` lines with a word, and of one long line: start, lines, selected hash, first and second hash of the whole window."""

    def each(x: Column) -> Column:
        lines, hashes = x["lines"], x["hashes"]

        def one(s: Column) -> Column:
            part = F.slice(lines, s + 1, run)
            selected = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(run - 1)), lambda o: F.struct(F.get(hashes, s + o).alias("h"), (-o).alias("back"))))
            return F.struct(
                s.alias("s"), F.lit(run).alias("n"), selected["h"].alias("selected"), F.xxhash64(part).alias("k1"), F.xxhash64(F.lit(run), part).alias("k2"),
                F.exists(part, lambda p: p.rlike(WORD)).alias("used"),
            )

        def alone(line: Column, s: Column) -> Column:
            part = F.array(line)
            k2 = F.xxhash64(F.lit(1), part)
            return F.struct(s.alias("s"), F.lit(1).alias("n"), k2.alias("selected"), F.xxhash64(part).alias("k1"), k2.alias("k2"), is_long(line, long_words).alias("used"))

        out = F.when(F.size(hashes) >= run, F.transform(F.sequence(F.lit(0), F.size(hashes) - run), one))
        if long_words is None or run == 1:
            return out
        return F.concat(F.coalesce(out, F.array()), F.filter(F.transform(lines, alone), lambda w: w["used"]))

    return let(F.split(text, "\n"), lambda ls: let(F.struct(ls.alias("lines"), F.transform(ls, lambda v: F.xxhash64(v)).alias("hashes")), each))


def repeated_spans(df: DataFrame, id_col: str, text_col: str, run: int, long_words: int | None) -> DataFrame:
    """Spans of lines to delete: _id, _row (hash of all columns), spans (array of first, last), for rows that have any."""
    rows = df.select(F.col(id_col).alias("_id"), row_hash(df).alias("_row"), F.explode_outer(windows(F.col(text_col), run, long_words)).alias("w"))
    rows = saved(rows.where("w.used").select("_id", "_row", "w.s", "w.n", "w.selected", "w.k1", "w.k2"), "line-windows")
    # written first: a join whose sides are both read from tables is split where a line is hot
    often = saved(rows.groupBy("selected").agg(F.count("*").alias("n")).where("n > 1").select("selected"), "line-anchors")
    near = rows.join(often, "selected", "left_semi")
    at = F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_row", "s")
    first = near.groupBy("k1", "k2").agg(F.min(at).alias("first"), F.count("*").alias("places")).where("places > 1").select("k1", "k2", "first")
    first = saved(first, "line-firsts")
    later = near.join(first, ["k1", "k2"]).where(at > F.col("first"))
    gone = F.collect_set(F.sequence("s", F.col("s") + F.col("n") - 1))
    gone = later.groupBy("_id", "_row").agg(F.sort_array(F.array_distinct(F.flatten(gone))).alias("v"))

    def spans(x: Column) -> Column:
        begins = F.filter(x, lambda s, i: (i == 0) | (s - F.get(x, i - 1) > 1))
        ends = F.filter(x, lambda s, i: (i == F.size(x) - 1) | (F.get(x, i + 1) - s > 1))
        return F.zip_with(begins, ends, lambda b, e: F.struct(b.alias("first"), e.alias("last")))

    return gone.select("_id", "_row", let(F.col("v"), spans).alias("spans"))


def without(text: Column, spans: Column) -> Column:
    """Text without the lines of the spans, which are in order and apart."""

    def kept(x: Column) -> Column:
        lines, gone = x["lines"], x["gone"]
        after = F.transform(gone, lambda g: g["last"] + 1)
        begins = F.concat(F.array(F.lit(0)), after)
        ends = F.concat(F.transform(gone, lambda g: g["first"]), F.array(F.size(lines)))
        parts = F.zip_with(begins, ends, lambda b, e: F.slice(lines, b + 1, e - b))
        return F.array_join(F.flatten(parts), "\n")

    return let(F.struct(F.split(text, "\n").alias("lines"), spans.alias("gone")), kept)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, long_words: int | None = LONG_WORDS) -> DataFrame:
    """Rows of `df` with later repeats of runs of `run` lines or more, and of long lines, deleted, and `_spans`, the deleted line numbers,
    with underscores behind the name if `df` has such a column.

    A run is a repeat if its lines stand in the same order earlier: in a row with a smaller id (null last; equal ids by a
    hash of the row) or before it in the same text. All is judged on the input. Rows that are equal in all columns are
    one document, and none is a repeat of the other. Lines end at \\n; windows without any word are left alone. Null and
    empty texts, and those of fewer than `run` lines and no long one, stay as they are; a line is long from `long_words`
    words or LONG_CHARS characters, and None leaves single lines alone; `_spans` is null where nothing was deleted. A
    text whose every line is a repeat becomes empty, its row stays. An empty table gives no rows.
    """
    found = repeated_spans(df, id_col, text_col, run, long_words)
    own = unused(df, "_hash")
    keyed = df.withColumn(own, row_hash(df))
    joined = keyed.join(found, (keyed[own] == found["_row"]) & keyed[id_col].eqNullSafe(found["_id"]), "left")
    text = F.when(found["spans"].isNull(), keyed[text_col]).otherwise(without(keyed[text_col], found["spans"]))
    return joined.select(*[text.alias(c) if c == text_col else keyed[quoted(c)] for c in df.columns], found["spans"].alias(unused(df, "_spans")))
