"""Toxicity by multiple-instance learning.

Only documents are labelled, yet a document is toxic because some of its sentences are. A sentence scores
sigmoid(bias + weights of its features), a document 1 - product(1 - sentence scores), the noisy-or; the weights are
fitted to the documents' labels through it. The sentence scores then tell where the offence lies.
Features are words and their first and last four and five letters. A sentence without any known feature scores 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroscope.llm.common import map_arrow, rows_out

SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]*")
LETTERS = re.compile(r"[^\W\d_]+")
#: Score of a document without evidence.
LEAK = 0.001
#: Labelled documents that the fit takes at most, and the longest text among them.
SAMPLE, LONGEST = 5000, 20_000
#: Tokens whose weight a process remembers before it starts anew.
KNOWN = 500_000


def features(token: str) -> set[str]:
    out = set()
    for word in LETTERS.findall(token.lower()):
        out.add(f"={word}")
        for n in (4, 5):
            if len(word) > n:
                out |= {f"^{word[:n]}", f"${word[-n:]}"}
    return out


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Spans that end after a run of full stops, marks or line ends and cover the text."""
    return (m.span() for m in SENTENCE.finditer(text) if m.end() > m.start())


def torn(text: str, at: int) -> bool:
    """Whether a sentence end at a place is inside a token."""
    return 0 < at < len(text) and not text[at - 1].isspace() and not text[at].isspace()


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]

    def scorer(self) -> TextScorer:
        return TextScorer(self)


class TextScorer:
    """Scores of whole texts; remembers the weight of tokens that it has met."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def learn(self, tokens: set[str]) -> None:
        if len(self.known) > KNOWN:
            self.known.clear()
        weights = self.model.weights
        for t in tokens:
            if t not in self.known:
                found = [weights[f] for f in features(t) if f in weights]
                self.known[t] = sum(found) if found else 0.0

    def spans(self, text: str) -> list[tuple[int, int, float]]:
        """Sentences with evidence: start, end, score."""
        tokens = set(text.split())
        self.learn(tokens)
        hot = {t: self.known[t] for t in tokens if self.known[t]}
        out = []
        if hot:
            for a, b in sentences(text):
                parts = text[a:b].split()
                z = sum(hot[t] for t in hot.keys() & parts)
                # a cut inside a token leaves parts that no whole token equals: they have weights of their own
                cut = {t for t, at in zip(parts[:1] + parts[-1:], (a, b)) if torn(text, at)} - hot.keys()
                if cut:
                    self.learn(cut)
                    z += sum(self.known[t] for t in cut)
                if z:
                    out.append((a, b, 1 / (1 + float(np.exp(-self.model.bias - z)))))
        return out

    def score(self, text: str) -> float:
        clean = 1.0 - LEAK
        for _, _, s in self.spans(text):
            clean *= 1.0 - s
        return 1.0 - clean


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 200, least: int = 3, ratio: float = 3.0, decay: float = 1e-3) -> Model:
    """Maximum likelihood of document labels under the noisy-or, by Adam; weights stay at or above zero.

    Takes features of `least` toxic documents or more that are at least `ratio` times as frequent in toxic documents
    as in others. Without toxic documents, or without such features, nothing is evidence.
    """
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for text, y in zip(texts, toxic):
        found = set()
        for t in set(text.split()):
            found |= features(t)
        seen[int(y)].update(found)
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    odds = {f: (c / n_bad) / ((seen[0][f] + 0.5) / n_good) for f, c in seen[1].items() if c >= least}
    chosen = sorted(f for f, o in odds.items() if o >= ratio)
    if not chosen:
        return Model(0.0, {})
    index = {f: i for i, f in enumerate(chosen)}
    seen[0].clear()
    seen[1].clear()
    chosen_of: dict[str, list[int] | None] = {}  # of each token
    docs, rows, cols = [], [], []  # of each sentence with features: its document; of each entry: sentence, feature
    for d, text in enumerate(texts):
        for a, b in sentences(text):
            found = set()
            for t in text[a:b].split():
                if t not in chosen_of:
                    chosen_of[t] = [index[f] for f in features(t) if f in index] or None
                if chosen_of[t]:
                    found.update(chosen_of[t])
            if found:
                rows += [len(docs)] * len(found)
                cols += found
                docs.append(d)
    docs, rows, cols = np.array(docs), np.array(rows), np.array(cols)
    y = toxic[docs].astype(float)
    w, bias = 0.5 * np.log([odds[f] for f in chosen]).clip(0, 4), -3.0
    params = np.r_[w, bias]
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        z = params[-1] + np.bincount(rows, params[cols], len(docs))
        s = 1 / (1 + np.exp(-z.clip(-30, 30)))
        clean = np.bincount(docs, np.log1p(-s.clip(0, 1 - 1e-9)), len(texts))
        p = (1 - np.exp(clean) * (1 - LEAK))[docs]
        dz = s * np.where(y > 0, -(1 - p) / p.clip(1e-3), 1.0)
        g = np.r_[np.bincount(cols, dz[rows], len(w)), dz.sum()] / len(texts) + decay / len(w) * np.r_[params[:-1], 0.0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        params[:-1] = params[:-1].clip(0, 12)
        params[-1] = params[-1].clip(-12, 0)
    return Model(round(float(params[-1]), 6), {f: round(float(x), 6) for f, x in zip(chosen, params) if x > 0.01})


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """Fits the model to at most `sample` labelled documents of at most `longest` characters, picked by a hash of their id.

    Held-out documents, null labels, ids and texts are left out. An id that repeats counts as toxic if any label says so.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_toxic"))
    # labels without a fitting document may be picked too, so pick twice the bound first
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(2 * sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.length("_text") <= longest)
    rows = rows.join(F.broadcast(known), "_id")  # at most 2 * sample rows of two numbers
    got = rows.groupBy("_id", "_toxic").agg(F.min("_text").alias("_text")).orderBy(F.xxhash64("_id"), "_id").limit(sample).toPandas()
    return fit(got["_text"].tolist(), got["_toxic"].to_numpy(dtype=np.int64))


def score_column(model: Model, text: Column) -> Column:
    """Score of a text, a null text being empty."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model.scorer()
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts.tolist()], dtype="float64")

    return score(F.coalesce(text, F.lit("")))


def locate(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Offending sentences: doc_id, start, end (characters), score. Texts without any give no rows."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def each(batches):
        scorer = model.scorer()
        for batch in batches:
            schema = pa.schema([("doc_id", batch.schema.field(0).type), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
            yield rows_out(
                ((d, a, b, s) for d, t in zip(*map(pa.Array.to_pylist, batch.columns)) for a, b, s in scorer.spans(t) if s >= least), schema
            )

    return map_arrow(rows, each, f"doc_id {kind}, start bigint, end bigint, score double")


def judge(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, n_offending, worst_start, worst_end for every row of `df`.

    Equal texts get equal scores, null and empty ones the score LEAK and no offending sentence. An empty table gives
    no rows. Other columns of `df` are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def each(batches):
        scorer = model.scorer()
        for batch in batches:
            out = []
            for doc_id, text in zip(*map(pa.Array.to_pylist, batch.columns)):
                spans = scorer.spans(text)
                clean = (1 - LEAK) * float(np.prod([1 - s for _, _, s in spans]))
                worst = max(spans, key=lambda x: x[2], default=(None, None, 0.0))
                out.append((doc_id, 1 - clean, sum(s >= 0.5 for _, _, s in spans), worst[0], worst[1]))
            yield rows_out(out, pa.schema([
                ("doc_id", batch.schema.field(0).type), ("score", pa.float64()), ("n_offending", pa.int64()), ("worst_start", pa.int64()), ("worst_end", pa.int64()),
            ]))

    found = map_arrow(rows, each, f"doc_id {kind}, score double, n_offending bigint, worst_start bigint, worst_end bigint")
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
        "n_offending", "worst_start", "worst_end",
    )
