"""Porter's 1980 suffix stripping, for the stemmed search path."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

#: Words whose stems a worker remembers, and words of the texts that it holds as lists at once.
KNOWN_WORDS, PIECE_WORDS = 100_000, 100_000


def _shape(word: str) -> str:
    """c for a consonant, v for a vowel, at each place; y after a consonant is a vowel."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and i and out[i - 1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c", _shape(word)))


def _vowel(word: str) -> bool:
    return "v" in _shape(word)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, rules) -> str:
    for end, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + new if _measure(stem) > 0 else word
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word; words of other alphabets and of two letters or fewer stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = next((e for e in ("ed", "ing") if word.endswith(e) and _vowel(word[: -len(e)])), None)
        if cut:
            word = word[: -len(cut)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _cvc(word):
                word += "e"
    if word.endswith("y") and _vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _STEP2), _STEP3)
    for end in sorted((*_STEP4, "ion"), key=lambda e: -len(e)):
        if word.endswith(end):
            base = word[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _cvc(base)):
            word = base
    if _measure(word) > 1 and _double(word) and word.endswith("l"):
        word = word[:-1]
    return word


def fold(text: str) -> str:
    """Lower case without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def _stemmed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    known: dict[str, str] = {}
    split = re.compile(r"[^\W_]+")
    kind = pa.list_(pa.string())

    def stems(text: str | None) -> list[str]:
        words = split.findall(fold(text)) if text else []
        for w in words:
            if w not in known:
                if len(known) >= KNOWN_WORDS:
                    known.clear()
                known[w] = stem(w)
        return [known[w] if w in known else stem(w) for w in words]

    for batch in texts:
        # a piece at a time, so that lists of words of few texts are held at once
        parts, rows, held = [], [], 0
        for text in batch:
            rows.append(stems(text.as_py()))
            held += len(rows[-1])
            if held >= PIECE_WORDS:
                parts.append(pa.array(rows, kind))
                rows, held = [], 0
        yield pa.concat_arrays([*parts, pa.array(rows, kind)])


def stemmed_tokens(text: Column) -> Column:
    """Stems of the folded words, in Arrow batches."""
    return F.arrow_udf(_stemmed, "array<string>")(text)
