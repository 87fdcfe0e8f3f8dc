"""Spoken text to compact codes (FL240, RWY04L, HDG270, AAL123) as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from aeroscope.functions import vocab
from aeroscope.idioms import let, lookup, replace_each

WORD_TO_NUMBER = {w: d for d, w in vocab.NUMBERS.items()}
SPELLED = {**WORD_TO_NUMBER, **{w: c for c, w in vocab.NATO.items()}}
HEARD = "zero|one|two|three|four|five|six|seven|eight|nine|niner"
HEARD_HEADING = "zero|one|two|three|four|five|six|seven|eight|nine"


def _digits(match: Column) -> Column:
    words = F.filter(F.split(match, r"\s+"), lambda w: w.isin(*WORD_TO_NUMBER))
    return F.array_join(F.transform(words, lambda w: lookup(w, WORD_TO_NUMBER)), "")


def _tagged(text: Column, pattern: str, tag: str, keep_space: bool) -> Column:
    def change(m: Column) -> Column:
        d = _digits(m)
        tail = F.regexp_extract(m, r"(\s*)$", 1) if keep_space else F.lit("")
        return F.when(d != "", F.concat(F.lit(tag), d, tail)).otherwise(m)

    return replace_each(text, pattern, change)


def compact_level(text: Column, keep_space: bool = False) -> Column:
    """The match takes the spaces behind it with it unless keep_space is set."""
    return _tagged(text, rf"(?i)flight\s+level\s+(?:(?:{HEARD})\s*)+", "FL", keep_space)


def compact_heading(text: Column, keep_space: bool = False) -> Column:
    return _tagged(text, rf"(?i)heading\s+(?:(?:{HEARD_HEADING})\s*)+", "HDG", keep_space)


def compact_runway(text: Column, keep_space: bool = False) -> Column:
    def change(m: Column) -> Column:
        d = _digits(m)
        last = F.element_at(F.split(F.trim(m), r"\s+"), -1)
        side = F.when(last.isin("left", "l"), "L").when(last.isin("right", "r"), "R").when(
            last.isin("center", "c"), "C"
        ).otherwise("")
        tail = F.regexp_extract(m, r"(\s*)$", 1) if keep_space else F.lit("")
        return F.when(d != "", F.concat(F.lit("RWY"), d, side, tail)).otherwise(m)

    return replace_each(text, rf"(?i)runway\s+(?:(?:{HEARD})\s*)+(?:left|right|center|L|R|C)?\b", change)


def compact_callsign(text: Column, airlines: Mapping[str, str] = vocab.AIRLINES, codes: Column | None = None) -> Column:
    """Airline name in the first one to three words, then spoken digits or letters.

    Names come from a dictionary of airlines, or from the map column `codes` (see vocab.spoken_code_map).
    """
    if codes is None:
        codes = vocab.spoken_codes(airlines)
        starts = sorted({name.split()[0] for name in codes})
    else:
        starts = None

    def named(words: Column, k: int) -> Column:
        code = lookup(F.array_join(F.slice(words, 1, k), " "), codes)

        def finish(rest: Column) -> Column:
            stop = F.array_position(F.transform(rest, lambda w: w.isin(*SPELLED)), F.lit(False)).cast("int")
            n = F.when(stop > 0, stop - 1).otherwise(F.size(rest))
            said = F.array_join(F.transform(F.slice(rest, 1, n), lambda w: lookup(w, SPELLED)), "")
            tail = F.array_join(F.slice(rest, n + 1, F.greatest(F.size(rest), F.lit(1))), " ")
            return F.when(code.isNotNull() & (n > 0), F.concat(code, said, F.lit(" "), tail))

        return F.when(
            F.size(words) > k, let(F.slice(words, k + 1, F.greatest(F.size(words), F.lit(1))), finish)
        )

    def change(words: Column) -> Column:
        # a hash test on the first word keeps the lookups off most rows
        found = F.coalesce(*[named(words, k) for k in (1, 2, 3)])
        return found if starts is None else F.when(words[0].isin(*starts), found)

    def either(t: Column) -> Column:
        words = F.split(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")), " ")
        return F.coalesce(let(words, change), t)

    return let(text, either)


def compact(text: Column, keep_space: bool = False, airlines: Mapping[str, str] = vocab.AIRLINES, codes: Column | None = None) -> Column:
    out = F.lower(text)
    out = compact_heading(compact_runway(compact_level(out, keep_space), keep_space), keep_space)
    out = compact_callsign(out, airlines, codes)
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))
