"""English stems by the rules of Porter (1980), for one word at a time; callers pass each distinct word once."""

from __future__ import annotations

from functools import lru_cache

# --- Fixed values: the published rules, in their order ---

STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

# --- end of the fixed values ---

VOWELS = frozenset("aeiou")


def shape(word: str) -> str:
    """``v`` for vowels, ``c`` for consonants; a y after a consonant is a vowel."""
    out = ""
    for ch in word:
        out += "v" if ch in VOWELS or ch == "y" and out.endswith("c") else "c"
    return out


def measure(word: str) -> int:
    """How many times a vowel is followed by a consonant."""
    return shape(word).count("vc")


def _has_vowel(word: str) -> bool:
    return "v" in shape(word)


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant other than w, x or y."""
    return shape(word).endswith("cvc") and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _replaced(word: str, rules: list[tuple[str, str]]) -> str:
    """The longest suffix decides, whether or not its condition holds."""
    found = _longest(word, [s for s, _ in rules])
    if found and measure(word[: -len(found)]) > 0:
        return word[: -len(found)] + dict(rules)[found]
    return word


def _plural(w: str) -> str:
    if w.endswith("sses") or w.endswith("ies"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    found = _longest(w, ("ed", "ing"))
    if not found or not _has_vowel(w[: -len(found)]):
        return w
    w = w[: -len(found)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if len(w) > 1 and w[-1] == w[-2] and shape(w)[-1] == "c" and w[-1] not in "lsz":
        return w[:-1]
    return w + "e" if measure(w) == 1 and _short_end(w) else w


def _tail(w: str) -> str:
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Stem of a lower-case word. Words of one or two letters, or with other characters than a-z, stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    w = _past(_plural(word))
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, STEP_2), STEP_3)
    found = _longest(w, STEP_4)
    if found and measure(w[: -len(found)]) > 1 and (found != "ion" or w[: -len(found)].endswith(("s", "t"))):
        w = w[: -len(found)]
    return _tail(w)
