"""Russian stemmer after the published Snowball algorithm, as regular expressions over one word.

Each step takes off the longest ending that holds its conditions: it starts in region RV (after the first vowel), and the endings of
a first group follow а or я, which may lie before RV. A lazy prefix makes the matcher find the longest ending first.
The expressions work alike in Python and in the JVM, so that the same steps are a Python function (query words) and a
column expression (texts).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The endings of the published algorithm.
VOWELS = "аеиоуыэюя"
GERUND_1, GERUND_2 = "в вши вшись", "ив ивши ившись ыв ывши ывшись"
ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею"
PARTICIPLE_1, PARTICIPLE_2 = "ем нн вш ющ щ", "ивш ывш ующ"
REFLEXIVE = "ся сь"
VERB_1 = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно"
VERB_2 = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю"
NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я"
SUPERLATIVE = "ейш ейше"
DERIVATIONAL = "ост ость"

_RV = f"[^{VOWELS}]*[{VOWELS}]"
_R2 = f".*?[{VOWELS}][^{VOWELS}].*?[{VOWELS}][^{VOWELS}]"


def _any(endings: str) -> str:
    return "(?:" + "|".join(sorted(endings.split(), key=len, reverse=True)) + ")"


def _step(ending: str, region: str = _RV) -> str:
    return f"^({region}.*?)(?:{ending})$"


_AFTER = "(?<=[ая])"
_GERUND = _step(f"{_AFTER}{_any(GERUND_1)}|{_any(GERUND_2)}")
_REFLEXIVE = _step(_any(REFLEXIVE))
_ADJECTIVAL = _step(f"(?:{_AFTER}{_any(PARTICIPLE_1)}|{_any(PARTICIPLE_2)})?{_any(ADJECTIVE)}")
_VERB = _step(f"{_AFTER}{_any(VERB_1)}|{_any(VERB_2)}")
_NOUN = _step(_any(NOUN))
_I = _step("и")
_DERIVATIONAL = _step(_any(DERIVATIONAL), _R2)
_SUPERLATIVE = _step(_any(SUPERLATIVE))
_NN = _step("нн")
_SOFT = _step("ь")
_CYRILLIC = "^[а-яё]{3,}$"


def stem(word: str) -> str:
    """Stem of a word; words of under three letters or with other letters than а-я and ё come back as they are."""
    low = word.lower()
    if not re.match(_CYRILLIC, low):
        return word

    def cut(pattern: str, w: str, to: str = r"\1") -> str:
        return re.sub(pattern, to, w)

    w = low.replace("ё", "е")
    one = cut(_GERUND, w)
    if one == w:
        w = cut(_REFLEXIVE, w)
        one = next((x for p in (_ADJECTIVAL, _VERB, _NOUN) if (x := cut(p, w)) != w), w)
    w = cut(_DERIVATIONAL, cut(_I, one))
    top = cut(_SUPERLATIVE, w)
    if top != w or re.search(_NN, w):
        return cut(_NN, top, r"\1н")
    return cut(_SOFT, w)


def stem_column(word: Column) -> Column:
    """The same steps as a column expression over a lower-cased word."""

    def cut(pattern: str, w: Column, to: str = "$1") -> Column:
        return F.regexp_replace(w, pattern, to)

    w = F.translate(word, "ё", "е")
    gerund = cut(_GERUND, w)
    plain = cut(_REFLEXIVE, w)
    adjectival, verb, noun = cut(_ADJECTIVAL, plain), cut(_VERB, plain), cut(_NOUN, plain)
    one = F.when(gerund != w, gerund).when(adjectival != plain, adjectival).when(verb != plain, verb).otherwise(noun)
    two = cut(_DERIVATIONAL, cut(_I, one))
    top = cut(_SUPERLATIVE, two)
    done = F.when((top != two) | two.rlike(_NN), cut(_NN, top, "$1н")).otherwise(cut(_SOFT, two))
    return F.when(word.rlike(_CYRILLIC), done).otherwise(word)
