"""Spoken-form normalisation of transcripts as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from aeroscope.functions import vocab
from aeroscope.idioms import first_group, let, lookup, replace_each

# (?U): word boundaries, digits and spaces follow Unicode, so accented words keep together.
UNI = "(?U)"
ANY = "(?iU)"

NAVAID = r"\b(?:ILS|VOR|NDB|DME|GS|LOC|VORDME|VORTAC)\d{1,3}(?:L|R|C)?\b"
DIGIT_WORD = "one|two|three|four|five|six|seven|eight|nine"


def spoken(digits: Column) -> Column:
    """A run of digits to words."""
    return F.trim(reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1] + " ")), vocab.DIGITS.items(), digits))


def spell_number(text: Column) -> Column:
    """Every character apart, digits as words."""
    chars = F.split(text, "")
    return F.array_join(F.transform(chars, lambda c: F.coalesce(lookup(c, vocab.DIGITS), c)), " ")


def split_navaids(text: Column) -> Column:
    return replace_each(
        text, ANY + NAVAID,
        lambda m: F.concat(
            F.lower(F.regexp_extract(m, r"^([A-Za-z]+)", 1)), F.lit(" "), F.regexp_extract(m, r"^[A-Za-z]+(.*)$", 1)
        ),
    )


def _coded(text: Column, letters: int, names: vocab.Airlines) -> Column:
    def change(m: Column) -> Column:
        name = lookup(F.substring(m, 1, letters), names)
        return F.coalesce(F.concat(name, F.lit(" "), spoken(F.substring(m, letters + 1, 8))), m)

    return replace_each(text, UNI + rf"\b[A-Z]{{{letters}}}\d{{1,4}}\b", change)


def icao_callsigns(text: Column, airlines: vocab.Airlines = vocab.AIRLINES) -> Column:
    return _coded(text, 3, airlines)


def iata_callsigns(text: Column, airlines: vocab.Airlines = vocab.AIRLINES) -> Column:
    return _coded(text, 2, vocab.iata_names(airlines))


def letter_callsigns(text: Column) -> Column:
    return _coded(text, 1, vocab.NATO)


def bare_numbers(text: Column) -> Column:
    return replace_each(text, UNI + r"\b\d{3,5}\b", spoken)


def flight_level(text: Column) -> Column:
    return replace_each(
        text, ANY + r"\b(?:FL|FLIGHT LEVEL)\s*\d{2,3}\b",
        lambda m: F.concat(F.lit("flight level "), spoken(F.regexp_extract(m, r"(\d+)$", 1))),
    )


def heading(text: Column) -> Column:
    return replace_each(
        text, ANY + r"\b(?:HDG|HEADING)\s*\d{3}\b",
        lambda m: F.concat(F.lit("heading "), spoken(F.regexp_extract(m, r"(\d+)$", 1))),
    )


def frequency(text: Column) -> Column:
    return replace_each(
        text, UNI + r"\b\d{2,3}\.\d{2,3}\b",
        lambda m: F.concat(
            spoken(F.substring_index(m, ".", 1)), F.lit(" decimal "), spoken(F.substring_index(m, ".", -1))
        ),
    )


def squawk(text: Column) -> Column:
    return replace_each(
        text, ANY + r"\b(?:SQUAWK|SQ)\s*\d{4}\b",
        lambda m: F.concat(F.lit("squawk "), spoken(F.right(m, F.lit(4)))),
    )


def runway(text: Column) -> Column:
    def change(m: Column) -> Column:
        prefix = F.when(F.lower(m).startswith("runway"), "runway ").otherwise("")
        side = F.when(F.upper(F.right(m, F.lit(1))) == "L", " left").otherwise(" right")
        return F.concat(prefix, spoken(F.regexp_extract(m, r"(\d+)[A-Za-z]$", 1)), side)

    return replace_each(text, ANY + r"\b(?:runway\s+)?\d{1,2}[LR]\b", change)


def _if_any(text: Column, words: Iterable[str], chain: Callable[[Column], Column]) -> Column:
    """Run a chain of replacements only on texts that hold one of the words."""
    hit = ANY + rf"\b(?:{'|'.join(words)})\b"
    return let(text, lambda t: F.when(t.rlike(hit), chain(t)).otherwise(t))


def abbreviations(text: Column) -> Column:
    return _if_any(
        text, vocab.ABBREVIATIONS,
        lambda t: reduce(
            lambda c, kv: F.regexp_replace(c, ANY + rf"\b{kv[0]}\b", kv[1]), vocab.ABBREVIATIONS.items(), t
        ),
    )


def all_numbers(text: Column) -> Column:
    return replace_each(text, UNI + r"\b\d+\b", spoken)


def compound_numbers(text: Column) -> Column:
    return _if_any(
        text, vocab.TENS,
        lambda t: reduce(
            lambda c, kv: F.regexp_replace(c, ANY + rf"\b{kv[0]}\s+({DIGIT_WORD})\b", kv[1] + " $1"),
            vocab.TENS.items(), t,
        ),
    )


def lone_tens(text: Column) -> Column:
    return _if_any(
        text, vocab.TENS,
        lambda t: reduce(
            lambda c, kv: F.regexp_replace(c, ANY + rf"\b{kv[0]}\b", kv[1] + " zero"), vocab.TENS.items(), t
        ),
    )


def nato_letters(word: Column) -> Column:
    return F.array_join(F.transform(F.split(word, ""), lambda c: F.coalesce(lookup(c, vocab.NATO), F.lower(c))), " ")


def waypoints(text: Column) -> Column:
    return replace_each(text, UNI + r"\b[A-Z]{4,5}\b", nato_letters)


def drop_punctuation(text: Column) -> Column:
    return F.translate(text, vocab.PUNCTUATION, " " * len(vocab.PUNCTUATION))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, UNI + r"\s+", " "))


def normalize(
    text: Column,
    expand_callsigns: bool = True,
    expand_numbers: bool = True,
    expand_icao: bool = False,
    normalize_terminology: bool = True,
    remove_punctuation: bool = True,
    lowercase: bool = True,
    convert_compound_numbers: bool = True,
    split_concatenated_terms: bool = True,
    airlines: vocab.Airlines = vocab.AIRLINES,
) -> Column:
    """Whole spoken-form normalisation; null or empty becomes ''."""
    out = text
    if split_concatenated_terms:
        out = split_navaids(out)
    if expand_callsigns:
        out = bare_numbers(letter_callsigns(iata_callsigns(icao_callsigns(out, airlines), airlines)))
    if normalize_terminology:
        for step in (flight_level, heading, frequency, squawk, runway, abbreviations):
            out = step(out)
    if expand_numbers:
        out = all_numbers(out)
    if convert_compound_numbers:
        out = lone_tens(compound_numbers(out))
    if expand_icao:
        out = waypoints(out)
    if remove_punctuation:
        out = drop_punctuation(out)
    out = squeeze(out)
    if lowercase:
        out = F.lower(out)
    return F.coalesce(F.trim(out), F.lit(""))


def normalize_map(data: Column, **switches) -> Column:
    """Normalise every value of a map column."""
    return F.transform_values(data, lambda _, v: normalize(v, **switches))


def expand_callsign(code: Column, airlines: vocab.Airlines = vocab.AIRLINES) -> Column:
    """One callsign in spoken form, null when it is not known."""
    c = F.upper(F.trim(code))
    three = first_group(c, r"^([A-Z]{3})\d+$")
    two = first_group(c, r"^([A-Z]{2})\d+$")
    name = F.coalesce(lookup(three, airlines), lookup(two, vocab.iata_names(airlines)))
    return F.concat(name, F.lit(" "), spoken(F.regexp_extract(c, r"(\d+)$", 1)))


def spell_icao(text: Column) -> Column:
    """Letters as spelling words, other letters and digits kept, the rest dropped."""
    chars = F.filter(F.split(F.upper(text), ""), lambda c: c.rlike(r"^[\p{L}\p{N}]$"))
    return F.array_join(F.transform(chars, lambda c: F.coalesce(lookup(c, vocab.NATO), F.lower(c))), " ")


def airline_name(code: Column, airlines: vocab.Airlines = vocab.AIRLINES) -> Column:
    c = F.upper(code)
    return F.coalesce(lookup(c, airlines), lookup(c, vocab.iata_names(airlines)))


def extract_callsigns(text: Column) -> Column:
    up = F.upper(text)
    return F.array_distinct(
        F.concat(
            F.regexp_extract_all(up, F.lit(UNI + r"\b([A-Z]{3}\d{1,4})\b"), F.lit(1)),
            F.regexp_extract_all(up, F.lit(UNI + r"\b([A-Z]{2}\d{1,4})\b"), F.lit(1)),
        )
    )
