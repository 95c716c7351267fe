"""Text functions as native Column expressions (no Python on the hot path)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters without a canonical decomposition, mapped the way
# database-side accent stripping maps them.
# ligatures (one letter -> two letters): œ oe, Œ OE, æ ae, Æ AE, ß ss
LIGATURES = {"œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE", "ß": "ss"}
# single letters: ø o, Ø O, đ d, Đ D, ł l, Ł L, ħ h, Ħ H, ŧ t, Ŧ T, ı i
STROKES = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L",
           "ħ": "h", "Ħ": "H", "ŧ": "t", "Ŧ": "T", "ı": "i"}


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """(source, target) strings for ``translate``: every Latin letter in
    U+00C0..U+024F whose compatibility decomposition is an ASCII letter
    followed by combining marks, plus the stroke letters above."""
    src, dst = [], []
    for cp in range(0x00C0, 0x0250):
        ch = chr(cp)
        dec = unicodedata.normalize("NFKD", ch)
        base = dec[0]
        if len(dec) > 1 and base.isascii() and base.isalpha() and all(
            unicodedata.combining(c) for c in dec[1:]
        ):
            src.append(ch)
            dst.append(base)
    for k, v in STROKES.items():
        src.append(k)
        dst.append(v)
    return "".join(src), "".join(dst)


def unaccent_py(s: str | None) -> str | None:
    """Driver-side twin of ``unaccent`` for literal values."""
    if s is None:
        return None
    src, dst = _accent_table()
    s = s.translate(str.maketrans(src, dst))
    for k, v in LIGATURES.items():
        s = s.replace(k, v)
    return s


def unaccent(c: Column) -> Column:
    """Strip accents (E16): one ``translate`` plus five ligature replaces."""
    src, dst = _accent_table()
    out = F.translate(c, src, dst)
    for k, v in LIGATURES.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def literal_underscores(v: str) -> str:
    """Escape the underscores that are not escaped yet, so that LIKE reads them as themselves."""
    return re.sub(r"(?<!\\)_", r"\\_", v)


def like_value(v: str) -> str:
    """The pattern of like/ilike (F8): a value with ``%`` is one already, any other is searched for anywhere."""
    return v if "%" in v else f"%{literal_underscores(v)}%"


def search_words(v: str) -> list[str]:
    """The words of a ``~`` search (F9), without accents."""
    return [literal_underscores(word) for word in unaccent_py(v).split(" ")]


def contains_all_words(c: Column, value: str) -> Column:
    """Accent- and case-insensitive "every word is contained" test."""
    if value == "":
        raise ValueError("empty search value")
    target = unaccent(c.cast("string"))
    out = None
    for w in search_words(value):
        t = target.ilike(f"%{w}%")
        out = t if out is None else (out & t)
    return out


def natural_keys(c: Column, letters_first: bool = True) -> list[Column]:
    """Natural-sort keys (O2/O3): leading letters run, digits run as a number, raw value."""
    s = c.cast("string")
    letters = F.regexp_substr(s, F.lit("[a-zA-Z]+"))
    digits = F.regexp_replace(F.regexp_substr(s, F.lit("[0-9]+")), "^0+(?=[0-9])", "")
    # numbers of any length compare as text once their number of digits stands before them
    number = F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)
    keys = [letters, number] if letters_first else [number, letters]
    return keys + [c]


def as_text(c: Column) -> Column:
    """Text form used by text comparisons."""
    return c.cast("string")


def before_first(c: Column, sep: str) -> Column:
    """Text before the first ``sep``; empty when ``sep`` is absent."""
    pos = F.instr(c, sep)
    return F.when(pos > 0, F.substring(c, F.lit(1), pos - 1)).otherwise(F.lit(""))


def concat0(*cols: Column, sep: str = "") -> Column:
    """NULL-tolerant concatenation."""
    return F.concat_ws(sep, *cols)


def nullif_blank(c: Column) -> Column:
    """``NULLIF(x, '')``."""
    return F.nullif(c, F.lit(""))


def json_of(names: list[str]) -> Column:
    """JSON object of listed columns, NULL written as empty text."""
    return F.to_json(F.struct(*[F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in names]))


def value_map(c: Column, mapping: dict) -> Column:
    """CASE value map with pass-through (E14).  Literal map: constant size, codegen'd."""
    if not mapping:
        return c
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, c.cast("string")), c.cast("string"))


def classify(cases: list[tuple[Column, object]], default=None) -> Column:
    """CASE WHEN classification."""
    out = None
    for cond, val in cases:
        v = val if isinstance(val, Column) else F.lit(val)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    d = default if isinstance(default, Column) else F.lit(default)
    return d if out is None else out.otherwise(d)


def round_half_up(c: Column, scale: int = 0) -> Column:
    """Null-safe ``ROUND(x::NUMERIC)``, half away from zero."""
    return F.round(c, scale)


def explode_list(c: Column, sep: str = ",") -> Column:
    """``UNNEST(STRING_TO_ARRAY(x, sep))`` with trimmed parts (E6); the separator is literal."""
    import re

    return F.explode(F.transform(F.split(c, re.escape(sep)), lambda x: F.trim(x)))


def split_list(c: Column, sep: str = ",") -> Column:
    import re

    return F.transform(F.split(c, re.escape(sep)), lambda x: F.trim(x))


def capitalise(c: Column) -> Column:
    """First letter upper case, rest unchanged."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def human_number(c: Column) -> Column:
    """Human-readable number with K/M/G suffix and one decimal."""
    a = F.abs(c)
    return (
        F.when(a >= 1e9, F.concat(F.format_number(c / 1e9, 1), F.lit("G")))
        .when(a >= 1e6, F.concat(F.format_number(c / 1e6, 1), F.lit("M")))
        .when(a >= 1e3, F.concat(F.format_number(c / 1e3, 1), F.lit("K")))
        .otherwise(F.format_number(c, 0))
    )


def show_date(c: Column) -> Column:
    """Day/month/year display."""
    return F.date_format(c, "dd/MM/yyyy")
