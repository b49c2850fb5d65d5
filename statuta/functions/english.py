"""English for full-text search: the stop list, and stems by the published Porter2 rules."""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The Snowball project's English stop words, in its order.
STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself",
    "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for",
    "with", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under",
    "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
)

# Fixed values of Porter2: whole words, words left alone after step 1a, prefixes that end before R1, and
# the suffixes of steps 2 to 4 as (suffix, replacement, letters of which one must stand before it, or None).
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
ALONE = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
PREFIXES = ("gener", "commun", "arsen")
STEP2 = (
    ("tional", "tion", None), ("enci", "ence", None), ("anci", "ance", None), ("abli", "able", None), ("entli", "ent", None), ("izer", "ize", None), ("ization", "ize", None),
    ("ational", "ate", None), ("ation", "ate", None), ("ator", "ate", None), ("alism", "al", None), ("aliti", "al", None), ("alli", "al", None), ("fulness", "ful", None),
    ("ousli", "ous", None), ("ousness", "ous", None), ("iveness", "ive", None), ("iviti", "ive", None), ("biliti", "ble", None), ("bli", "ble", None), ("ogi", "og", "l"),
    ("fulli", "ful", None), ("lessli", "less", None), ("li", "", "cdeghkmnrt"),
)
STEP3 = (("tional", "tion", None), ("ational", "ate", None), ("alize", "al", None), ("icate", "ic", None), ("iciti", "ic", None), ("ical", "ic", None), ("ful", "", None), ("ness", "", None))
STEP4 = tuple((x, "", "st" if x == "ion" else None) for x in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"))

#: What a word is: letters and digits, lower case.
TOKEN = r"[\p{L}\p{N}]+"

_STOP = frozenset(STOP_WORDS)
_REGION = re.compile("[^aeiouy]*[aeiouy]+[^aeiouy]")
_SHORT = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_Y = re.compile("([aeiouy])y")
_PLURAL = re.compile("[aeiouy].")
_TENSE = re.compile("(.*[aeiouy].*)(?:ed|edly|ing|ingly)")
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LAST_Y = re.compile("(?<=.[^aeiouy])[yY]$")


def _by_last(rules: tuple) -> dict[str, list]:
    """Rules by the last letter of their suffixes, longest first."""
    out: dict[str, list] = {}
    for r in sorted(rules, key=lambda r: -len(r[0])):
        out.setdefault(r[0][-1], []).append(r)
    return out


_STEP = {n: _by_last(rules) for n, rules in ((2, STEP2), (3, STEP3), (4, STEP4))}
_STEP3_ENDS = tuple(s for s, _, _ in STEP3)


def _replaced(w: str, step: int, start: int) -> str:
    """The longest suffix of a step replaced where it stands in the region from ``start``."""
    for suffix, to, before in _STEP[step].get(w[-1:], ()):
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            return w[:at] + to if at >= start and (before is None or (at and w[at - 1] in before)) else w
    return w


def _after(w: str, at: int) -> int:
    found = _REGION.match(w, at)
    return found.end() if found else len(w)


def stem(word: str) -> str:
    """The Porter2 stem of a lower-case word. Words of less than three letters and words with digits stay."""
    if len(word) < 3 or not word.isalpha():
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = word if "y" not in word else _Y.sub(r"\1Y", "Y" + word[1:] if word[0] == "y" else word)
    r1 = next(len(p) for p in PREFIXES if w.startswith(p)) if w.startswith(PREFIXES) else _after(w, 0)
    r2 = _after(w, r1)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _PLURAL.search(w[:-1]):
        w = w[:-1]
    if w in ALONE:
        return w
    # tenses
    if w.endswith(("eed", "eedly")):
        at = w.rindex("eed")
        w = w[: at + 2] if at >= r1 else w
    elif w.endswith(("ed", "edly", "ing", "ingly")) and (cut := _TENSE.fullmatch(w)) is not None:
        w = cut[1]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLE):
            w = w[:-1]
        elif r1 >= len(w) and _SHORT.search(w):
            w += "e"
    if w.endswith(("y", "Y")):
        w = _LAST_Y.sub("i", w)
    # derived forms
    w = _replaced(w, 2, r1)
    if w.endswith("ative") and not w.endswith(_STEP3_ENDS):
        w = w[:-5] if len(w) - 5 >= r2 else w
    else:
        w = _replaced(w, 3, r1)
    w = _replaced(w, 4, r2)
    at = len(w) - 1
    if w.endswith("e") and (at >= r2 or (at >= r1 and not _SHORT.search(w[:-1]))) or w.endswith("ll") and at >= r2:
        w = w[:-1]
    return w.lower()


@functools.lru_cache(1 << 19)
def lexeme(word: str) -> str | None:
    """The term that a word stands for in full-text search; none for stop words."""
    return None if word in _STOP else stem(word)


def lexemes(words: Column, only: list[str] | None = None) -> Column:
    """Arrays of lexeme(), nulls at stop words, from arrays of lower-case words: each distinct word of
    an Arrow batch is worked out once. only: terms beside which all are null."""
    some = None if only is None else frozenset(only)

    def run(arrays: pa.Array) -> pa.Array:
        flat = arrays.flatten().dictionary_encode()
        found = [lexeme(w) for w in flat.dictionary.to_pylist()]
        terms = pa.array(found if some is None else [t if t in some else None for t in found], pa.string()).take(flat.indices)
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), pa.array(arrays.value_lengths().to_numpy(zero_copy_only=False).cumsum(), pa.int32())])
        return pa.ListArray.from_arrays(offsets, terms)

    return F.arrow_udf(run, "array<string>")(words)


def may_be(word: Column, terms: list[str]) -> Column:
    """Whether a lower-case word may have one of some stems. The rules leave what stands before the last two letters of a
    stem, and its first two, as it is in the word, but for words given whole."""
    starts = sorted({t[: max(2, len(t) - 2)] for t in terms})
    whole = sorted(w for w, t in WHOLE.items() if t in terms)
    if len(starts) > 16:
        return word.isin(whole) | word.rlike(f"^(?:{'|'.join(starts)})")
    return functools.reduce(lambda a, s: a | word.startswith(s), starts, word.isin(whole) if whole else F.lit(False))


def words_of(text: Column) -> Column:
    """Array of a text's lower-case words; null texts have none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1)), F.array().cast("array<string>"))
