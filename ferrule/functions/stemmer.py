"""The Snowball stemmer for Russian, after its published description; other words stay as they are."""

from __future__ import annotations

VOWELS = frozenset("аеиоуыэюя")
# The endings of the published algorithm.
PERFECTIVE_1 = ("вшись", "вши", "в")
PERFECTIVE_2 = ("ившись", "ывшись", "ивши", "ывши", "ив", "ыв")
ADJECTIVE = "ими ыми его ого ему ому ее ие ые ое ей ий ый ой ем им ым ом их ых ую юю ая яя ою ею".split()
PARTICIPLE_1 = "ем нн вш ющ щ".split()
PARTICIPLE_2 = "ивш ывш ующ".split()
REFLEXIVE = ("ся", "сь")
VERB_1 = "ете йте ешь нно ла на ли ем ло но ет ют ны ть й л н".split()
VERB_2 = "ейте уйте ила ыла ена ите или ыли ило ыло ено ует уют ены ить ыть ишь ей уй ил ыл им ым ен ят ит ыт ую ю".split()
NOUN = "иями ями ами ией иям ием иях ев ов ие ье еи ии ей ой ий ям ем ам ом ах ях ию ью ия ья а е и й о у ы ь ю я".split()
SUPERLATIVE = ("ейше", "ейш")
DERIVATIONAL = ("ость", "ост")


def _regions(word: str) -> tuple[int, int]:
    """Where RV and R2 begin."""
    rv = next((i + 1 for i, c in enumerate(word) if c in VOWELS), len(word))

    def after(start: int) -> int:
        return next((i + 1 for i in range(start + 1, len(word)) if word[i] not in VOWELS and word[i - 1] in VOWELS), len(word))

    r1 = after(0)
    return rv, after(r1) if r1 < len(word) else len(word)


def _cut(word: str, start: int, endings, before: str = "") -> str | None:
    """The word without the longest of the endings that lies after ``start``, or None; before: letters of which one must come before it, also after start."""
    for e in sorted(endings, key=len, reverse=True):
        at = len(word) - len(e)
        if at >= start and word.endswith(e):
            if before and not (at - 1 >= start and word[at - 1] in before):
                return None
            return word[:at]
    return None


def _longest(word: str, start: int, first, second) -> str | None:
    """Of two groups of endings, the first of which needs a or ya before it, the longest ending that fits."""
    for e, group in sorted([(e, 1) for e in first] + [(e, 2) for e in second], key=lambda x: -len(x[0])):
        at = len(word) - len(e)
        if at >= start and word.endswith(e) and (group == 2 or (at - 1 >= start and word[at - 1] in "ая")):
            return word[:at]
    return None


def stem(word: str) -> str:
    """The stem of a word in lower case; a word without a Russian vowel stays as it is."""
    word = word.replace("ё", "е")
    rv, r2 = _regions(word)
    if rv >= len(word):
        return word
    cut = _longest(word, rv, PERFECTIVE_1, PERFECTIVE_2)
    if cut is None:
        base = _cut(word, rv, REFLEXIVE)
        base = word if base is None else base
        cut = _cut(base, rv, ADJECTIVE)
        if cut is not None:
            participle = _longest(cut, rv, PARTICIPLE_1, PARTICIPLE_2)
            cut = cut if participle is None else participle
        else:
            cut = _longest(base, rv, VERB_1, VERB_2)
            if cut is None:
                cut = _cut(base, rv, NOUN)
        cut = base if cut is None else cut
    word = cut
    if word.endswith("и") and len(word) - 1 >= rv:
        word = word[:-1]
    cut = _cut(word, r2, DERIVATIONAL)
    word = word if cut is None else cut
    if word.endswith("нн") and len(word) - 2 >= rv:
        return word[:-1]
    cut = _cut(word, rv, SUPERLATIVE)
    if cut is not None:
        return cut[:-1] if cut.endswith("нн") and len(cut) - 2 >= rv else cut
    return word[:-1] if word.endswith("ь") and len(word) - 1 >= rv else word
