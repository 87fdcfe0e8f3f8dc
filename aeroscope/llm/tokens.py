"""Token ids of many texts by a public word-level BPE file.

In such a file white space only separates and every word is encoded on its own. So the ids of a text are those of its
words; each process keeps the words that it has met, up to a bound, and asks the tokenizer for new ones only.
"""

from __future__ import annotations

import gc
import json
import os
import unicodedata
from collections.abc import Callable
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

#: Words of a generation: when there are more, those not met in the next one are forgotten.
KNOWN = 500_000
#: Words that the tokenizer is asked for at once.
LEARNT = 20_000
#: Last of the Latin, Greek and Cyrillic letters that all versions of Unicode in use have.
TRUSTED = "\u052f"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def encoder(path: str) -> Callable[[list[str] | pa.Array], list[bytes]]:
    """A function from texts to their ids as little-endian unsigned 32-bit bytes."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    with open(path) as f:
        spec = json.load(f)
    kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
    split, byte_level = spec["pre_tokenizer"]["pretokenizers"]
    if kinds != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or byte_level["use_regex"] or not spec["model"]["end_of_word_suffix"]:
        raise ValueError(f"{path} is not a word-level BPE file")
    pieces = regex.compile(split["pattern"]["Regex"]).findall
    # special tokens have ids of their own; four controls are white space to Python but not to the file's pattern
    whole_only = [*[x["content"] for x in spec["added_tokens"]], "\x1c", "\x1d", "\x1e", "\x1f"]
    whole = Tokenizer.from_file(path)
    spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, byte_level]}}
    words = Tokenizer.from_str(json.dumps(spec))
    suffix = spec["model"]["end_of_word_suffix"]
    ends_word = np.zeros(1 + max(spec["model"]["vocab"].values()), dtype=bool)
    ends_word[[i for token, i in spec["model"]["vocab"].items() if token.endswith(suffix)]] = True
    known: dict[str, bytes] = {}
    parts: dict[str, bytes] = {}
    before: dict[str, bytes] = {}  # words of the generation that ended last: those met again move on

    def to_bytes(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def learn(new: list[str]) -> None:
        """Ids of new words; plain ones, a run of letters, are looked at together."""
        if not " ".join(new).isascii():
            # what a letter is changes with Unicode's version beyond the oldest scripts: there the library itself is asked
            odd = [w for w in new if max(w) > TRUSTED]
            known.update((w, to_bytes(whole.encode(w, add_special_tokens=False).ids)) for w in odd)
            new = [w for w in new if max(w) <= TRUSTED] if odd else new
        line = lower(" ".join(new))
        low = line.split(" ")
        if len(low) != len(new):
            low = [lower(w) for w in new]
        if line.replace(" ", "").isalpha() and len(low) > 1:
            cut = [[w] for w in low]
        else:
            cut = [parted(w) for w in low]
        fresh = [p for p in dict.fromkeys(chain.from_iterable(cut)) if p not in parts]
        if fresh:  # each piece ends with the only id of its own that ends a word
            ids = np.array(words.encode_batch_fast([" ".join(fresh)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (4 * np.flatnonzero(ends_word[ids]) + 4).tolist()
            raw = ids.tobytes()
            parts.update(zip(fresh, [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)], strict=True))
        known.update(zip(new, [parts[x[0]] if len(x) == 1 else b"".join([parts[p] for p in x]) for x in cut]))

    def lower(word: str) -> str:
        if word.isascii():
            return word.lower()
        word = unicodedata.normalize("NFC", word)
        return "".join([c.lower() for c in word]) if "\u03a3" in word else word.lower()  # Python looks at what stands around a sigma

    def parted(word: str) -> list[str]:
        if word.isalpha():
            return [word]
        if word[-1:] in ".,;:!?" and word[:-1].isalpha():
            return [word[:-1], word[-1]]
        return pieces(word)

    def encode(texts: list[str] | pa.Array) -> list[bytes]:
        texts = texts if isinstance(texts, list) else texts.to_pylist()
        collects = gc.isenabled()
        gc.disable()  # new words are many small lists without cycles
        try:
            return [ids_of(text) for text in texts]
        finally:
            if collects:
                gc.enable()

    def ids_of(text: str) -> bytes:
        nonlocal before
        if any(s in text for s in whole_only):
            return to_bytes(whole.encode(text, add_special_tokens=False).ids)
        if len(known) > KNOWN:
            before = known.copy()
            known.clear()
            parts.clear()
        known[""] = b""
        split = text.split(" ") if text.isascii() and text.isprintable() else text.split()
        found = list(map(known.get, split))
        if None in found:
            places = [k for k, ids in enumerate(found) if ids is None]
            new = dict.fromkeys([split[k] for k in places])
            for w in [w for w in new if w in before]:
                known[w] = before[w]
                del new[w]
            new = list(new)
            for at in range(0, len(new), LEARNT):
                learn(new[at : at + LEARNT])
            for k in places:
                found[k] = known[split[k]]
        return b"".join(found)

    return encode
