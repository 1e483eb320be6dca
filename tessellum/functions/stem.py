"""English stems by Porter's algorithm (1980), as Columns and as SQL from the same rules.

Vowels and consonants of a stem are told by regular expressions: a consonant run, a vowel run
(y counts as a vowel unless it begins a word or follows a vowel), and the number of
vowel-consonant sequences.  Each step is one expression on a bound variable, so steps do not
multiply.  Words of other scripts, with digits or of up to two letters stay as they are.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
SOME = f"^({_C})?{_V}{_C}"  # at least one vowel-consonant sequence
ONE = f"^({_C})?{_V}{_C}({_V})?$"
MORE = f"^({_C})?{_V}{_C}{_V}{_C}"  # at least two
VOWEL = f"^({_C})?[aeiouy]"
SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"
DOUBLED = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"

# The suffixes of each step and what takes their place.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


class _Columns:
    """The few operations the steps need, over Columns."""

    @staticmethod
    def like(x: Column, pattern: str) -> Column:
        return x.rlike(pattern)

    @staticmethod
    def cut(x: Column, n: int) -> Column:
        return F.substr(x, F.lit(1), F.length(x) - n)

    @staticmethod
    def plus(x: Column, tail: str) -> Column:
        return F.concat(x, F.lit(tail)) if tail else x

    @staticmethod
    def cases(pairs: list, otherwise: Column) -> Column:
        out = F.when(*pairs[0])
        for test, value in pairs[1:]:
            out = out.when(test, value)
        return out.otherwise(otherwise)

    @staticmethod
    def both(a: Column, b: Column) -> Column:
        return a & b

    @staticmethod
    def none(a: Column) -> Column:
        return ~a


class _Sql:
    """The same over SQL text."""

    like = staticmethod(lambda x, pattern: f"regexp_matches({x}, '{pattern}')")
    cut = staticmethod(lambda x, n: f"substr({x}, 1, length({x}) - {n})")
    plus = staticmethod(lambda x, tail: f"({x} || '{tail}')" if tail else x)
    cases = staticmethod(lambda pairs, otherwise: "CASE " + " ".join(f"WHEN {t} THEN {v}" for t, v in pairs) + f" ELSE {otherwise} END")
    both = staticmethod(lambda a, b: f"({a} AND {b})")
    none = staticmethod(lambda a: f"(NOT {a})")


def _longest_first(suffixes) -> list[str]:  # noqa: ANN001
    return sorted(suffixes, key=lambda s: (-len(s), s))


def _plural(o, x):  # noqa: ANN001, ANN202
    return o.cases([(o.like(x, "(sses|ies)$"), o.cut(x, 2)), (o.like(x, "ss$"), x), (o.like(x, "s$"), o.cut(x, 1))], x)


def _past(o, x):  # noqa: ANN001, ANN202
    """A removed -ed or -ing leaves a mark for the next step, which mends the stem."""
    cut = lambda n: o.plus(o.cut(x, n), "#")
    return o.cases(
        [
            (o.both(o.like(x, "eed$"), o.like(o.cut(x, 3), SOME)), o.cut(x, 1)),
            (o.like(x, "eed$"), x),
            (o.both(o.like(x, "ed$"), o.like(o.cut(x, 2), VOWEL)), cut(2)),
            (o.both(o.like(x, "ing$"), o.like(o.cut(x, 3), VOWEL)), cut(3)),
        ],
        x,
    )


def _mended(o, x):  # noqa: ANN001, ANN202
    stem = o.cut(x, 1)
    return o.cases([(o.none(o.like(x, "#$")), x), (o.like(stem, "(at|bl|iz)$"), o.plus(stem, "e")), (o.like(stem, DOUBLED), o.cut(x, 2)), (o.like(stem, SHORT), o.plus(stem, "e"))], stem)


def _final_y(o, x):  # noqa: ANN001, ANN202
    return o.cases([(o.both(o.like(x, "y$"), o.like(o.cut(x, 1), VOWEL)), o.plus(o.cut(x, 1), "i"))], x)


def _mapped(table: dict[str, str], o, x):  # noqa: ANN001, ANN202
    pairs = []
    for s in _longest_first(table):
        stem = o.cut(x, len(s))
        pairs += [(o.both(o.like(x, f"{s}$"), o.like(stem, SOME)), o.plus(stem, table[s])), (o.like(x, f"{s}$"), x)]
    return o.cases(pairs, x)


def _dropped(o, x):  # noqa: ANN001, ANN202
    pairs = []
    for s in _longest_first([*STEP_4, "ion"]):
        stem = o.cut(x, len(s))
        fits = o.both(o.like(stem, MORE), o.like(stem, "[st]$")) if s == "ion" else o.like(stem, MORE)
        pairs += [(o.both(o.like(x, f"{s}$"), fits), stem), (o.like(x, f"{s}$"), x)]
    return o.cases(pairs, x)


def _final_e(o, x):  # noqa: ANN001, ANN202
    stem = o.cut(x, 1)
    one = o.both(o.like(stem, ONE), o.none(o.like(stem, SHORT)))
    return o.cases([(o.both(o.like(x, "e$"), o.like(stem, MORE)), stem), (o.both(o.like(x, "e$"), one), stem)], x)


def _final_l(o, x):  # noqa: ANN001, ANN202
    return o.cases([(o.both(o.like(x, "ll$"), o.like(x, MORE)), o.cut(x, 1))], x)


STEPS = (_plural, _past, _mended, _final_y, functools.partial(_mapped, STEP_2), functools.partial(_mapped, STEP_3), _dropped, _final_e, _final_l)


def stems_of(words: Column) -> Column:
    """An array of lower-case words to their stems."""
    for step in STEPS:
        words = F.transform(words, functools.partial(_guarded, step))
    return words


def _guarded(step, x: Column) -> Column:  # noqa: ANN001
    return F.when(x.rlike("^[a-z]{3,}#?$"), step(_Columns, x)).otherwise(x)


def stem(word: Column) -> Column:
    return F.element_at(stems_of(F.array(word)), 1)


def stems_sql(words: str) -> str:
    for step in STEPS:
        words = f"list_transform({words}, lambda x: CASE WHEN regexp_matches(x, '^[a-z]{{3,}}#?$') THEN {step(_Sql, 'x')} ELSE x END)"
    return words
