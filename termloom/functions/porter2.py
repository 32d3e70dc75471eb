"""The English (Porter2) stemming algorithm, from its published description."""

from __future__ import annotations

import re
from functools import lru_cache

#: Stems remembered by a process.
REMEMBERED = 200_000
VOWELS = "aeiouy"
_V, _C = f"[{VOWELS}]", f"[^{VOWELS}]"
_VOWEL, _AFTER = re.compile(_V), re.compile(f"{_V}{_C}")
_SHORT_END, _SHORT_WORD = re.compile(f"{_C}{_V}[^{VOWELS}wxY]$"), re.compile(f"{_V}{_C}")
_CONSONANT_Y, _FINAL_Y = re.compile(f"^y|(?<={_V})y"), re.compile(f"(?<=.{_C})[yY]$")
_POSSESSIVE, _EED, _PAST = re.compile("('s'|'s|')$"), re.compile("(eedly|eed)$"), re.compile("(ingly|edly|ing|ed)$")
# Fixed values of the algorithm: exceptional forms, stems that stay, and doubles.
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
STAY = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
PREFIXES = ("gener", "commun", "arsen")
STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("ousness", "ous"), ("iveness", "ive"), ("fulness", "ful"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"),
    ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
ENDINGS2, ENDINGS3 = (tuple(ending for ending, _ in step) for step in (STEP2, STEP3))


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    r1 = next((len(p) for p in PREFIXES if word.startswith(p)), None)
    if r1 is None:
        m = _AFTER.search(word)
        r1 = m.end() if m else len(word)
    m = _AFTER.search(word, r1)
    return r1, m.end() if m else len(word)


def _short_end(word: str) -> bool:
    return bool(_SHORT_END.search(word) or _SHORT_WORD.fullmatch(word))


def stem(word: str) -> str:
    """The stem of a lower-cased word."""
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = word.replace("’", "'").removeprefix("'")
    if "y" in w:
        w = _CONSONANT_Y.sub("Y", w)
    r1, r2 = _regions(w)
    if "'" in w:
        w = _POSSESSIVE.sub("", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in STAY:
        return w
    # past and continuous forms
    if m := _EED.search(w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := _PAST.search(w)) and _VOWEL.search(w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif len(w) <= r1 and _short_end(w):
            w += "e"
    # a final y after a consonant
    w = _FINAL_Y.sub("i", w)
    for ending, to in STEP2 if w.endswith(ENDINGS2) else ():
        if w.endswith(ending):
            before = w[: -len(ending)]
            if len(before) >= r1 and (ending != "ogi" or before.endswith("l")) and (ending != "li" or before.endswith(tuple("cdeghkmnrt"))):
                w = before + to
            break
    for ending, to in STEP3 if w.endswith(ENDINGS3) else ():
        if w.endswith(ending):
            before = w[: -len(ending)]
            if len(before) >= (r2 if ending == "ative" else r1):
                w = before + to
            break
    for ending in STEP4 if w.endswith(STEP4) else ():
        if w.endswith(ending):
            before = w[: -len(ending)]
            if len(before) >= r2 and (ending != "ion" or before.endswith(("s", "t"))):
                w = before
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@lru_cache(REMEMBERED)
def remembered(word: str) -> str:
    return stem(word)
