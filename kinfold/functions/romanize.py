"""Indic scripts to Latin letters, as businesses write their names.

The nine blocks share one layout, so one table of offsets serves them all; what differs from script to script is
listed by script. Each word has a primary and an alternate reading.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Latin readings by offset in a block.
_VOWELS = {0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0B: "ri", 0x0C: "li", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x11: "o", 0x12: "o", 0x13: "o", 0x14: "au", 0x60: "ri", 0x61: "li"}
_SIGNS = {0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u", 0x43: "ri", 0x46: "e", 0x47: "e", 0x48: "ai", 0x49: "o", 0x4A: "o", 0x4B: "o", 0x4C: "au", 0x57: "au"}
_CONSONANTS = {
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "n", 0x1A: "ch", 0x1B: "chh", 0x1C: "j", 0x1D: "jh", 0x1E: "n",
    0x1F: "t", 0x20: "th", 0x21: "d", 0x22: "dh", 0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n",
    0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x32: "l", 0x35: "v", 0x36: "sh",
    0x37: "sh", 0x38: "s", 0x39: "h",
}
_ALTERNATES = {0x2B: "f", 0x35: "w", 0x37: "s"}
_SHORT = {0x05, 0x06, 0x07, 0x08, 0x09, 0x0A, 0x0F, 0x10, 0x13, 0x14}
_PLAIN_SIGNS = {0x3E, 0x3F, 0x40, 0x41, 0x42, 0x47, 0x48, 0x4B, 0x4C}
_SOUTH = (_SHORT | {0x0E, 0x12}, _PLAIN_SIGNS | {0x46, 0x4A})

# Fixed values by script: block, vowels, vowel signs, deviations (consonants, None for absent), alternates, nasal sign,
# spelt-out letter names, conjuncts.
_SCRIPTS = (
    (0x0900, _SHORT | {0x0B, 0x0C, 0x11, 0x60, 0x61}, _PLAIN_SIGNS | {0x43, 0x49}, {}, _ALTERNATES, "ँ",
     {"एल": "l", "बी": "b", "सी": "s", "डी": "d", "जी": "g", "पी": "p", "एस": "s", "टी": "t", "एम": "m", "एन": "n", "एच": "h", "आर": "r", "के": "k", "एफ": "f", "यू": "u", "आई": "i", "एजी": "g", "ओ": "o", "ऐ": "a"}, {"क्ष": "x", "श्र": "shr", "ज्ञ": "gy"}),
    (0x0980, _SHORT | {0x0B}, _PLAIN_SIGNS | {0x43}, {0x2F: "j", 0x35: None}, {0x2B: "f", 0x2D: "v", 0x37: "s"}, "ঁ",
     {"এল": "l", "বি": "b", "এস": "s", "ডি": "d", "জি": "g", "পি": "p", "টি": "t", "এম": "m", "এন": "n", "আর": "r", "কে": "k"}, {"ক্ষ": "x", "শ্র": "shr"}),
    (0x0A00, _SHORT, _PLAIN_SIGNS, {0x36: None, 0x37: None}, {0x2B: "f", 0x35: "w"}, "ੑ",
     {"ਏਲ": "l", "ਬੀ": "b", "ਸੀ": "s", "ਡੀ": "d", "ਜੀ": "g", "ਪੀ": "p", "ਟੀ": "t", "ਏਮ": "m", "ਏਨ": "n", "ਆਰ": "r", "ਕੇ": "k"}, {"ਕ੍ਸ਼": "x", "ਸ਼੍ਰ": "shr"}),
    (0x0A80, _SHORT, _PLAIN_SIGNS, {}, _ALTERNATES, "ઁ",
     {"એલ": "l", "બી": "b", "સી": "s", "ડી": "d", "જી": "g", "પી": "p", "ટી": "t", "એમ": "m", "એન": "n", "આર": "r", "કે": "k"}, {"ક્ષ": "x", "શ્ર": "shr"}),
    (0x0B00, _SHORT, _PLAIN_SIGNS, {}, _ALTERNATES, "ଁ",
     {"ଏଲ": "l", "ବି": "b", "ସି": "s", "ଡି": "d", "ଜି": "g", "ପି": "p", "ଟି": "t", "ଏମ": "m", "ଏନ": "n", "ଆର": "r", "କେ": "k"}, {"କ୍ଷ": "x", "ଶ୍ର": "shr"}),
    (0x0B80, *_SOUTH, {0x1A: "s", 0x29: "n", 0x31: "r", 0x33: "l", 0x34: "l"} | dict.fromkeys((0x16, 0x17, 0x18, 0x1B, 0x1D, 0x20, 0x21, 0x22, 0x25, 0x26, 0x27, 0x2B, 0x2C, 0x2D, 0x36)), {0x1A: "ch", 0x37: "s"}, "",
     {"எல்": "l", "பி": "b", "எஸ்": "s", "டி": "d", "ஜி": "g", "எம்": "m", "என்": "n", "ஆர்": "r", "கே": "k", "சி": "s"}, {"க்ஷ": "x", "ஸ்ரீ": "sri"}),
    (0x0C00, *_SOUTH, {}, _ALTERNATES, "ఁ",
     {"ఎల్": "l", "బీ": "b", "సీ": "s", "డీ": "d", "జీ": "g", "పీ": "p", "టీ": "t", "ఎమ్": "m", "ఎన్": "n", "ఆర్": "r", "కే": "k", "ఎఫ్": "f"}, {"క్ష": "x", "శ్ర": "shr"}),
    (0x0C80, *_SOUTH, {}, _ALTERNATES, "ಁ",
     {"ಎಲ್": "l", "ಬಿ": "b", "ಸಿ": "s", "ಡಿ": "d", "ಜಿ": "g", "ಪಿ": "p", "ಟಿ": "t", "ಎಮ್": "m", "ಎನ್": "n", "ಆರ್": "r", "ಕೆ": "k"}, {"ಕ್ಷ": "x", "ಶ್ರ": "shr"}),
    (0x0D00, _SHORT | {0x0E, 0x12}, (_PLAIN_SIGNS | {0x46, 0x4A, 0x57}) - {0x4C}, {}, _ALTERNATES, "",
     {"എൽ": "l", "ബി": "b", "എസ്": "s", "ഡി": "d", "ജി": "g", "പി": "p", "ടി": "t", "എം": "m", "എൻ": "n", "ആർ": "r", "കേ": "k"}, {"ക്ഷ": "x", "ശ്ര": "shr"}),
)
_CHILLUS = {"ൺ": "n", "ൻ": "n", "ർ": "r", "ൽ": "l", "ൾ": "l", "ൿ": "k"}
_INDIC = re.compile("[ऀ-ൿ]")


@lru_cache(maxsize=1)
def _tables() -> tuple:
    """(consonants, signs, others, viramas, letter names, conjuncts), readings as (primary, alternate)."""
    consonants, signs, others, viramas = {}, {}, {}, set()
    names, conjuncts = [], []
    for base, vowels, vowel_signs, own, alternates, nasal, letters, joined in _SCRIPTS:
        for k, x in (_CONSONANTS | own).items():
            if x is not None:
                consonants[chr(base + k)] = x, alternates.get(k, x)
        signs |= {chr(base + k): (_SIGNS[k],) * 2 for k in vowel_signs}
        others |= {chr(base + k): (_VOWELS[k],) * 2 for k in vowels}
        others |= {chr(base + 0x66 + k): (str(k),) * 2 for k in range(10)}
        others |= {chr(base + 0x02): ("n", "m"), chr(base + 0x03): ("h", "h")}
        if nasal:
            others[nasal] = "n", "n"
        viramas.add(chr(base + 0x4D))
        names += list(letters.items())
        conjuncts += list(joined.items())
    others |= {k: (v, v) for k, v in _CHILLUS.items()} | dict.fromkeys("‌‍⁠", ("", "")) | dict.fromkeys("।॥", (" ", " "))
    return consonants, signs, others, viramas, sorted(names, key=lambda x: -len(x[0])), conjuncts


@lru_cache(maxsize=100_000)
def romanize_word(word: str) -> tuple[str, str]:
    """Primary and alternate reading of one word.

    A word that spells letter names only is read letter by letter; else a letter name at its head is. A consonant
    carries an inherent a unless a vowel sign or virama follows, and a final inherent a is dropped from longer words.
    """
    consonants, signs, others, viramas, names, conjuncts = _tables()
    letters, rest = "", word
    while rest and (hit := next((n for n in names if rest.startswith(n[0])), None)):
        letters, rest = letters + hit[1], rest[len(hit[0]) :]
    if letters and not rest:
        return letters, letters
    head = next((n for n in names if word.startswith(n[0])), None)
    if head:
        word = head[1] + word[len(head[0]) :]
    for pattern, latin in conjuncts:
        word = word.replace(pattern, latin)
    out: list[tuple[str, str]] = []
    inherent = False
    k = 0
    while k < len(word):
        c, after = word[k], word[k + 1 : k + 2]
        inherent_before, inherent = inherent, False
        if c in consonants:
            vowel = ("", "") if after in viramas else signs.get(after)
            k += vowel is not None
            inherent = vowel is None
            out.append(tuple(x + y for x, y in zip(consonants[c], vowel or ("a", "a"))))
        elif c.isascii() and c.isalnum():
            out.append((c.lower(),) * 2)
        elif c in signs or c in others:
            out.append(signs.get(c) or others[c])
        elif c in viramas:
            out.append(("", ""))
        else:
            inherent = inherent_before  # what is not known leaves no trace
        k += 1
    return tuple(x[:-1] if inherent and len(x) > 2 else x for x in ("".join(p) for p in (zip(*out) if out else ("", ""))))


def romanize_text(text: str) -> tuple[str, str]:
    words = unicodedata.normalize("NFKC", text).split()
    read = [romanize_word(w) if _INDIC.search(w) else (w, w) for w in words]
    return " ".join(r[0] for r in read), " ".join(r[1] for r in read)


@F.pandas_udf(StructType([StructField("primary", StringType()), StructField("alternate", StringType())]))
def romanize(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None) if t is None else romanize_text(t) for t in text], columns=["primary", "alternate"])


def romanize_variants(text: Column) -> Column:
    """One or two distinct readings."""
    r = romanize(text)
    return F.array_distinct(F.array(r["primary"], r["alternate"]))
