"""Quality by weak supervision.

Rules look at signals of a text and vote good (1), bad (-1) or abstain (0). Expectation-maximisation estimates from the
votes alone how accurate each rule is on good and on bad texts, and each text gets the posterior probability of being
good. So one rule that fails no longer rejects a text, and rules that are often wrong count for little.

All texts are counted: the votes of a text are one of 3^rules patterns, and the estimates need only how often each
pattern occurs. That histogram, of a size that the rules fix, is all that comes to the driver.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroscope.llm.common import map_arrow, saved

SYMBOLS = b"#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r "
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_closed_lines", "n_upper", "n_bare", "n_top_word")


@dataclass(frozen=True)
class Rule:
    """Votes by a share of two signals; abstains between the limits and below `least` of the denominator."""

    name: str
    part: str
    whole: str
    good: tuple[float, float]
    bad: tuple[float, float]
    least: int = 1

    def vote(self) -> Column:
        share = F.try_divide(F.col(self.part), F.col(self.whole))
        enough = F.col(self.whole) >= self.least
        return (
            F.when(enough & share.between(*self.good), 1)
            .when(enough & ~share.between(*self.bad), -1)
            .otherwise(0)
        )


#: Good inside the first limits, bad outside the second.
RULES = (
    Rule("word_length", "word_chars", "n_words", (3.8, 6.5), (3.0, 10.0), 20),
    Rule("symbols", "n_symbols", "word_chars", (0.0, 0.02), (0.0, 0.08), 40),
    Rule("repeats", "n_repeat_words", "n_words", (0.0, 0.1), (0.0, 0.4), 20),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", (0.0, 0.05), (0.0, 0.4), 4),
    Rule("closed_lines", "n_closed_lines", "n_lines", (0.75, 1.0), (0.2, 1.0), 3),
    Rule("capitals", "n_upper", "n_words", (0.0, 0.1), (0.0, 0.5), 20),
    Rule("plain_words", "n_bare", "n_words", (0.85, 1.0), (0.65, 1.0), 20),
    Rule("top_word", "n_top_word", "n_words", (0.0, 0.12), (0.0, 0.3), 50),
)


def signals(text: str) -> tuple[int, ...]:
    """The SIGNALS of one text. Words are what ASCII white space separates; a line counts if it has a word."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        many = {w for w, c in Counter(windows).items() if c > 1}
        if many:
            reach = 0  # words before it are counted
            for i, w in enumerate(windows):
                if w in many:
                    repeated += i + 3 - max(i, reach)
                    reach = i + 3
    closed = sum(x.rstrip()[-1:] in b".!?:;" for x in lines)
    tops = Counter(words)
    upper = sum(c for w, c in tops.items() if len(w) > 1 and w.isupper())
    bare = sum(c for w, c in tops.items() if w.strip(b".,;:'\"()").decode().isalpha())
    return n, word_chars, n_symbols, len(lines) - len(set(lines)), repeated, len(lines), closed, upper, bare, max(tops.values(), default=0)


def measure(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and the SIGNALS; a null text has none of anything."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def each(batches):
        for batch in batches:
            found = np.array([signals(t) for t in batch.column(1).to_pylist()], dtype=np.int64).reshape(-1, len(SIGNALS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, np.ascontiguousarray(found.T))], ["doc_id", *SIGNALS])

    return map_arrow(rows, each, f"doc_id {kind}, " + ", ".join(f"{s} bigint" for s in SIGNALS))


@dataclass(frozen=True)
class LabelModel:
    """Prior of good, and each rule's accuracy on good and on bad texts where it votes."""

    prior: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def log_odds(self, votes: list[Column]) -> Column:
        prior = F.lit(float(np.log(self.prior / (1 - self.prior))))
        terms = [
            F.when(v == 1, F.lit(float(np.log(g / (1 - b))))).when(v == -1, F.lit(float(np.log((1 - g) / b)))).otherwise(F.lit(0.0))
            for v, g, b in zip(votes, self.on_good, self.on_bad)
        ]
        return reduce(add, terms, prior)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> LabelModel:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) and how often each occurs.

    Starts from the majority of votes. Accuracies are held within 0.5 and 0.99, so that the two classes can't change
    places, and are smoothed by a few imagined votes.
    """
    rules = patterns.shape[1]
    if not len(patterns) or not counts.sum():
        return LabelModel(0.5, (0.7,) * rules, (0.7,) * rules)
    good_vote, bad_vote = patterns == 1, patterns == -1
    good = 1 / (1 + np.exp(-patterns.sum(axis=1)))
    for _ in range(rounds):
        w_good, w_bad = counts * good, counts * (1 - good)
        prior = np.clip((w_good.sum() + 1) / (counts.sum() + 2), 0.01, 0.99)
        on_good = np.clip((w_good @ good_vote + 7) / (w_good @ (good_vote | bad_vote) + 10), 0.5, 0.99)
        on_bad = np.clip((w_bad @ bad_vote + 7) / (w_bad @ (good_vote | bad_vote) + 10), 0.5, 0.99)
        odds = np.log(prior / (1 - prior)) + good_vote @ np.log(on_good / (1 - on_bad)) + bad_vote @ np.log((1 - on_good) / on_bad)
        good = 1 / (1 + np.exp(-odds))
    return LabelModel(float(prior), tuple(on_good.tolist()), tuple(on_bad.tolist()))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of `df`: doc_id, the SIGNALS, base_failed, posterior (of being good), kept.

    A text fails the base if it has under 50 words or if over half of them lie in repeated three-word windows; the rest
    is kept from a posterior of one half on. Null and empty texts get no votes and fail the base. Equal texts get equal
    rows, whatever their ids. An empty table gives no rows. Other columns of `df` are not read.
    """
    found = saved(measure(df, id_col, text_col), "signals")
    votes = {f"vote_{r.name}": r.vote() for r in rules}
    histogram = found.groupBy(*[v.alias(n) for n, v in votes.items()]).agg(F.count("*").alias("n")).collect()
    patterns = np.array([r[:-1] for r in histogram], dtype=np.int64).reshape(-1, len(rules))
    order = np.lexsort(patterns.T) if len(patterns) else []
    model = fit(patterns[order], np.array([r["n"] for r in histogram], dtype=np.float64)[order])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    posterior = 1 / (1 + F.exp(-model.log_odds(list(votes.values()))))
    return found.select(
        "doc_id", *SIGNALS, failed.alias("base_failed"), F.round(posterior, 9).alias("posterior"), (~failed & (posterior >= 0.5)).alias("kept")
    )
