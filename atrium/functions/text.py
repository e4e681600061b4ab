"""Text normalisation and matching as Columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Characters below this are folded by a table if they fold to one character; all others go through ``unicodedata``.
_TABLE_END = 0x3000


def folded(text: str, form: str) -> str:
    """A text in a normal form without combining marks."""
    return "".join(c for c in unicodedata.normalize(form, text) if not unicodedata.combining(c))


def _folding(form: str) -> tuple[dict[str, str], str]:
    """The characters that fold to one other character, and a regex for those that the table and the dropping of marks can't fold."""
    table, known = {}, []
    for code in range(_TABLE_END):
        c = chr(code)
        f = folded(c, form)
        if f != c and len(f) == 1:
            table[c] = f
        elif f != c and not (f == "" and unicodedata.category(c) == "Mn"):
            continue
        elif f == c and unicodedata.category(c) == "Mn":
            continue  # a mark that doesn't combine stays
        if known and known[-1][1] == code - 1:
            known[-1][1] = code
        else:
            known.append([code, code])
    ranges = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in known)
    return table, f"[^{ranges}]"


_TABLES = {form: _folding(form) for form in ("NFD", "NFKD")}


def _by_unicodedata(form: str):
    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        import unicodedata

        known: dict[str, bool] = {}  # whether a character is a mark

        def keep(t: str) -> str:
            if t.isascii():
                return t
            t = unicodedata.normalize(form, t)
            for c in set(t):
                if c not in known:
                    known[c] = unicodedata.combining(c) != 0
                if known[c]:
                    t = t.replace(c, "")
            return t

        return texts.map(keep, na_action="ignore")

    return fold


def _fold(text: Column, form: str) -> Column:
    """Accents off: nothing to do in ASCII; by a table and without Python for most other texts, by ``unicodedata`` for those
    that hold anything else. The long regex for these looks at what isn't ASCII only."""
    table, other = _TABLES[form]
    native = F.regexp_replace(F.translate(text, "".join(table), "".join(table.values())), r"\p{Mn}+", "")
    odd = F.regexp_like(F.regexp_replace(text, r"[\x00-\x7F]+", ""), F.lit(other))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, text).when(odd, _by_unicodedata(form)(F.when(~plain & odd, text))).otherwise(native)


def strip_accents(text: Column) -> Column:
    """NFD without marks."""
    return _fold(text, "NFD")


def normalize_floor_text(text: Column) -> Column:
    """NFKD without marks, lower case; empty for null. A raised o becomes a letter o."""
    return F.coalesce(F.lower(_fold(text, "NFKD")), F.lit(""))


def _one_space(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def bare_text(text: Column) -> Column:
    """Lower case, no accents, no spaces at the ends: what the forms of OCR text, labels and plain text are made from."""
    return strip_accents(F.lower(F.btrim(text)))


def ocr_form(bare: Column) -> Column:
    out = F.replace(bare, F.lit("-"), F.lit(" "))
    out = _one_space(F.regexp_replace(out, r"[^\p{L}\p{N} ._/]", ""))
    return F.btrim(F.when(out.endswith(".") & (F.length(out) <= 5), F.substring(out, F.lit(1), F.length(out) - 1)).otherwise(out))


def label_form(bare: Column) -> Column:
    return _one_space(F.replace(bare, F.lit("-"), F.lit(" ")))


def plain_form(bare: Column) -> Column:
    return _one_space(bare)


def normalize_ocr_text(text: Column) -> Column:
    """Lower case, no accents, hyphens to spaces, letters, digits and ``. _ /`` only; a short text loses its final dot."""
    return ocr_form(bare_text(text))


def normalize_label(text: Column) -> Column:
    """Lower case, no accents, hyphens to spaces, one space between words."""
    return label_form(bare_text(text))


def normalize_plain(text: Column) -> Column:
    """Lower case, no accents, one space between words."""
    return plain_form(bare_text(text))


def contains_any(text: Column, targets: list[str]) -> Column:
    """Whether a text is or contains one of ``targets``; false for an empty text."""
    out = F.lit(False)
    for t in targets:
        out = out | text.contains(t)
    return F.coalesce(out & (text != ""), F.lit(False))


def tokens_match(tokens: Column, targets: list[str]) -> Column:
    """Whether a token is a target, or both words of "soggiorno pranzo" are there and it is one."""
    out = F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in targets]))
    if "soggiorno pranzo" in targets:
        out = out | (F.array_contains(tokens, "soggiorno") & F.array_contains(tokens, "pranzo"))
    return F.coalesce(out, F.lit(False))


def section_number(name: Column) -> Column:
    """The number after "section" in a name, else its last digits, else the name."""
    named, last = F.regexp_extract(name, r"(?i)section[_-]?(\d+)", 1), F.regexp_extract(name, r"(\d+)$", 1)
    return F.when(named != "", named).when(last != "", last).otherwise(name)
