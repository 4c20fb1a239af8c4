"""Text cleaning with the reference's (ICU-based) rules, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from limnos.functions.util import as_col

# ICU's \s is [\t\n\f\r\p{Z}]; Java's \s is ASCII only, so spell it out.
WS = r"[\t\n\f\r\p{Z}]"
# Characters kept by [[:alnum:][:punct:] ] under ICU: alphabetic, decimal
# digits, Unicode punctuation (not symbols such as $ < > + = ^ ~) and space.
NOT_ALNUM_PUNCT_SPACE = r"[^\p{IsAlphabetic}\p{Nd}\p{P} ]"
# Sentence ends: '!' or '?' then blank; '.' then blank unless the next letter
# is lower case (ICU does not break "etc. and").
SENTENCE_SPLIT = (r"(?<=[!?])(?=" + WS + r")|(?<=\.)(?=" + WS + r")(?!" + WS
                  + r"+[^\p{L}.!?]*\p{Ll})")
# Word starts for title case: after anything but a letter, mark, digit,
# apostrophe or full stop (ICU keeps "o'brien" and "a.b" as one word).
WORD_SPLIT = r"(?<=[^\p{L}\p{M}\p{N}'’.])"


def squish(c) -> Column:
    """``str_squish``: trim and collapse inner whitespace runs to one space."""
    return F.trim(F.regexp_replace(as_col(c), WS + "+", " "))


def strip_non_alnum_punct(c) -> Column:
    """``str_replace_all(x, "[^[:alnum:][:punct:] ]", "")`` with ICU classes."""
    return F.regexp_replace(as_col(c), NOT_ALNUM_PUNCT_SPACE, "")


def clean_station_name(c) -> Column:
    return squish(strip_non_alnum_punct(c))


def strip_line_breaks(c) -> Column:
    return F.regexp_replace(as_col(c), r"[\r\n]", "")


def _cap_first(piece: Column) -> Column:
    # upper-case the first letter or digit after any leading blanks/punctuation
    # (mostly the very first character: no search then)
    pos = F.regexp_instr(piece, F.lit(r"[\p{L}\p{N}]"))
    at_start = F.concat(F.upper(F.left(piece, F.lit(1))), F.substr(piece, F.lit(2)))
    return F.when(piece.rlike("^[0-9A-Za-z]"), at_start).when(pos == 0, piece).otherwise(F.concat(
        F.substr(piece, F.lit(1), pos - 1), F.upper(F.substr(piece, pos, F.lit(1))),
        F.substr(piece, pos + 1)))


def sentence_case(c) -> Column:
    """``str_to_sentence``: lower case, first letter of each sentence upper."""
    c = as_col(c)
    # most values are one sentence: skip the split when no terminator is
    # followed by a blank
    one = _cap_first(F.lower(c))
    pieces = F.split(c, SENTENCE_SPLIT)
    many = F.array_join(F.transform(pieces, lambda p: _cap_first(F.lower(p))), "")
    return F.when(c.rlike(r"[.!?]" + WS), many).otherwise(one)


def title_case(c) -> Column:
    """``str_to_title``: every word capitalised, hyphen parts included."""
    c = as_col(c)
    pieces = F.split(F.lower(c), WORD_SPLIT)
    words = F.array_join(
        F.transform(pieces, lambda w: F.concat(F.upper(F.left(w, F.lit(1))),
                                               F.substr(w, F.lit(2)))), "")
    # most values are plain letters and blanks: no search for word starts then
    return F.when(c.rlike("^[A-Za-z ]*$"), F.initcap(c)).otherwise(words)


# --- column-name normalisation (metadata only, runs on the driver) --------

_CAMEL_1 = re.compile(r"([a-z0-9])([A-Z])")
_CAMEL_2 = re.compile(r"([A-Z]+)([A-Z][a-z])")


def _words(name: str) -> list[str]:
    name = name.replace("%", " percent ").replace("#", " number ")
    name = _CAMEL_2.sub(r"\1 \2", _CAMEL_1.sub(r"\1 \2", name))
    return [w for w in re.split(r"[^0-9A-Za-z]+", name) if w]


def snake_name(name: str) -> str:
    words = [w.lower() for w in _words(name)]
    out = "_".join(words) or "x"
    return "x" + out if out[0].isdigit() else out


def big_camel_name(name: str) -> str:
    out = "".join(w[:1].upper() + w[1:].lower() for w in _words(name)) or "X"
    return "X" + out if out[0].isdigit() else out


def unique_names(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen.get(n, 0) + 1
        seen[n] = k
        out.append(n if k == 1 else f"{n}_{k}")
    return out


def clean_names(df, case: str = "snake"):
    """``janitor::clean_names`` for a DataFrame (snake_case or BigCamel)."""
    fn = snake_name if case == "snake" else big_camel_name
    return df.toDF(*unique_names([fn(c) for c in df.columns]))
