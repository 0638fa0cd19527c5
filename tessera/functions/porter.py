"""The Porter stemming algorithm (M. F. Porter, "An algorithm for suffix stripping", 1980), written from the paper."""

from __future__ import annotations

from functools import lru_cache

# The suffix rules of steps 2, 3 and 4 of the paper.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

LONGEST_FIRST = {id(rules): sorted(rules, key=len, reverse=True) for rules in (STEP_2, STEP_3, STEP_4)}


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel behind a consonant."""
    out: list[str] = []
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and i > 0 and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def measure(word: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _shape(word).count("vc")


def _ends_cvc(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _replace_longest(word: str, rules: dict[str, str]) -> str:
    for suffix in LONGEST_FIRST[id(rules)]:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + rules[suffix] if measure(stem) > 0 else word
    return word


def _plurals_and_tenses(word: str) -> str:
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word[: -len(suffix)]
        if word.endswith(suffix):
            if "v" not in _shape(stem):
                return word
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double(stem) and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if measure(stem) == 1 and _ends_cvc(stem) else stem
    return word


@lru_cache(200_000)
def stem_word(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) < 3:
        return word
    word = _plurals_and_tenses(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace_longest(_replace_longest(word, STEP_2), STEP_3)
    for suffix in LONGEST_FIRST[id(STEP_4)]:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if measure(stem) > 1 or (measure(stem) == 1 and not _ends_cvc(stem)):
            word = stem
    if measure(word) > 1 and _double(word) and word.endswith("l"):
        word = word[:-1]
    return word
