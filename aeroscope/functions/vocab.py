"""Fixed vocabulary values and the airline table parameter."""

from __future__ import annotations

import csv
import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spelling alphabet.
NATO = {
    "A": "alpha", "B": "bravo", "C": "charlie", "D": "delta", "E": "echo", "F": "foxtrot", "G": "golf",
    "H": "hotel", "I": "india", "J": "juliett", "K": "kilo", "L": "lima", "M": "mike", "N": "november",
    "O": "oscar", "P": "papa", "Q": "quebec", "R": "romeo", "S": "sierra", "T": "tango", "U": "uniform",
    "V": "victor", "W": "whiskey", "X": "xray", "Y": "yankee", "Z": "zulu",
}

# Spoken digits.
DIGITS = {
    "0": "zero", "1": "one", "2": "two", "3": "three", "4": "four", "5": "five", "6": "six", "7": "seven",
    "8": "eight", "9": "nine",
}
NUMBERS = {**DIGITS, "10": "ten"}

# Two-letter airline codes and their three-letter codes.
IATA = {
    "AA": "AAL", "AC": "ACA", "AF": "AFR", "AI": "AIC", "AR": "ARG", "AT": "RAM", "AV": "AVA", "AY": "FIN",
    "B6": "JBU", "BA": "BAW", "BY": "TOM", "CA": "CCA", "CM": "CMP", "CU": "CUB", "CX": "CPA", "CZ": "CSN",
    "DE": "CFG", "DL": "DAL", "DY": "NAX", "EI": "EIN", "EK": "UAE", "EN": "DLH", "ET": "ETH", "EY": "ETD",
    "FI": "ICE", "FR": "RYR", "FX": "FDX", "IB": "IBE", "JJ": "TAM", "JL": "JAL", "KE": "KAL", "KL": "KLM",
    "KQ": "KQA", "LA": "LAN", "LH": "DLH", "LO": "LOT", "LX": "SWR", "LY": "ELY", "MH": "MAS", "MQ": "ENY",
    "MS": "MSR", "MU": "CES", "MX": "MXY", "NH": "ANA", "NK": "NKS", "NZ": "ANZ", "OH": "RPA", "OK": "CSA",
    "OS": "AUA", "PR": "PAL", "PT": "PDT", "QK": "JZA", "QR": "QTR", "QX": "QXE", "SA": "SAA", "SK": "SAS",
    "SQ": "SIA", "SV": "SVA", "SY": "SCX", "TK": "THY", "TP": "TAP", "U2": "EZY", "UA": "UAL", "VN": "VNA",
    "VS": "VIR", "VY": "VLG", "W6": "WZZ", "WN": "SWA", "WS": "WJA", "Y4": "VIV", "YX": "RPA", "ZW": "AWI",
    "5X": "UPS",
}

#: Airline table (code, name) that the text functions use unless they are given another one.
AIRLINES_FILE = os.environ.get("AEROSCOPE_AIRLINES") or os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "data", "airlines.csv")


def load_airlines(path: str = AIRLINES_FILE) -> dict[str, str]:
    """Names by three-letter code from a CSV file (code, name; lines with # are remarks), in order of the codes."""
    with open(path, encoding="utf-8", newline="") as f:
        rows = csv.DictReader(line for line in f if not line.startswith("#"))
        return dict(sorted((r["code"].strip().upper(), r["name"].strip().lower()) for r in rows))


AIRLINES = load_airlines()

# Spoken airline variants that map straight to a code.
SPOKEN_AIRLINES = {
    "alaska airline": "ASA", "alaska airlines": "ASA", "american airline": "AAL", "american airlines": "AAL",
    "british airway": "BAW", "british airways": "BAW", "continental airline": "COA",
    "continental airlines": "COA", "delta airline": "DAL", "delta airlines": "DAL",
    "frontier airline": "FFT", "frontier airlines": "FFT", "jetblue": "JBU", "southwest airline": "SWA",
    "southwest airlines": "SWA", "spirit airline": "NK", "spirit airlines": "NK", "united airline": "UAL",
    "united airlines": "UAL",
}

# Abbreviations and their words, applied in this order.
ABBREVIATIONS = {
    "tfc": "traffic", "wx": "weather", "dep": "departure", "arr": "arrival", "app": "approach",
    "twr": "tower", "gnd": "ground", "ctr": "center", "hab": "havana", "pax": "passengers", "rad": "radar",
    "nav": "navigation", "hdg": "heading", "alt": "altitude", "spd": "speed", "pos": "position",
    "vis": "visibility", "nm": "nautical miles", "ft": "feet", "rwy": "runway", "taxiwy": "taxiway",
    "clnc": "clearance", "atis": "atis", "notam": "notam", "metar": "metar", "taf": "taf", "niner": "nine",
}

# Tens.
TENS = {
    "ten": "one", "twenty": "two", "thirty": "three", "forty": "four", "fifty": "five", "sixty": "six",
    "seventy": "seven", "eighty": "eight", "ninety": "nine",
}

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


#: Airlines by three-letter code: a dictionary, or a map column made from a table.
Airlines = Mapping[str, str] | Column


def airline_map(airlines: DataFrame) -> Column:
    """A table of airlines (code, name; one row per three-letter code, so 17,576 at most) as a map column.

    It is a subquery: give it to a DataFrame as a column, and that column to the text functions.
    """
    return airlines.agg(F.map_from_entries(F.collect_list(F.struct("code", "name")))).scalar()


def spoken_code_map(airlines: DataFrame) -> Column:
    """`spoken_codes` of a table of airlines (code, name) as a map column; to be used as that of `airline_map`."""
    whole = airlines.groupBy("name").agg(F.max("code").alias("whole"))
    first = airlines.groupBy(F.split("name", " ")[0].alias("name")).agg(F.min("code").alias("first"))
    names = whole.join(first, "name", "full").select("name", F.coalesce("whole", "first").alias("code"))
    names = names.where(~F.col("name").isin(*SPOKEN_AIRLINES))
    own = F.create_map(*[F.lit(x) for kv in SPOKEN_AIRLINES.items() for x in kv])
    return names.agg(F.map_concat(F.map_from_entries(F.collect_list(F.struct("name", "code"))), own)).scalar()


def iata_names(airlines: Airlines = AIRLINES) -> Airlines:
    """Two-letter code to spoken name, only where the three-letter code is known."""
    if isinstance(airlines, Column):
        known = F.array(*[F.struct(F.lit(two).alias("two"), F.lit(three).alias("three")) for two, three in IATA.items()])
        named = F.transform(known, lambda x: F.struct(x["two"].alias("key"), airlines[x["three"]].alias("value")))
        return F.map_from_entries(F.filter(named, lambda x: x["value"].isNotNull()))
    return {two: airlines[three] for two, three in IATA.items() if three in airlines}


def spoken_codes(airlines: Mapping[str, str] = AIRLINES) -> dict[str, str]:
    """Spoken airline name (or its first word, unless taken) to three-letter code."""
    names: dict[str, str] = {}
    for code, name in sorted(airlines.items()):
        names[name] = code
        names.setdefault(name.split()[0], code)
    return {**names, **SPOKEN_AIRLINES}
