"""Scalar functions as column expressions: they stay in the JVM and inside whole-stage code."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import fixed


@lru_cache(1)
def _accents() -> tuple[str, str, dict[str, str]]:
    """Latin letters with accents and what they decompose to: one-to-one for translate(), and those of several letters."""
    src, dst, longer = "", "", {}
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07)]:
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain != c and len(plain) == 1:
            src, dst = src + c, dst + plain
        elif plain != c and plain:
            longer[c] = plain
    return src, dst, longer


def unaccent(c: Column) -> Column:
    """Accents off: combining marks are dropped, precomposed Latin letters replaced."""
    src, dst, longer = _accents()
    out = F.translate(F.regexp_replace(c, r"\p{M}+", ""), src, dst)
    common = {k: v for k, v in longer.items() if k in "ﬀﬁﬂ½¼¾ŉ"}
    for a, b in common.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fold(c: Column) -> Column:
    return F.lower(unaccent(F.coalesce(c, F.lit(""))))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def name_key(c: Column) -> Column:
    """The key under which spellings of one name meet."""
    plain = F.regexp_replace(F.trim(F.lower(unaccent(c))), r"(?U)[^\w\s]", " ")
    return collapse(F.regexp_replace(plain, "(?U)" + fixed.COMPANY_SUFFIX, " "))


def acronym(c: Column) -> Column:
    """Initials of the words that count, of the name's key."""
    words = F.filter(F.split(name_key(c), " "), lambda w: (w != "") & ~w.isin(*fixed.ACRONYM_STOP))
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def looks_like_acronym(c: Column) -> Column:
    return F.trim(c).rlike(r"^[A-Z][A-Z0-9]{1,7}$")


def short_name(c: Column) -> Column:
    return F.btrim(collapse(F.regexp_replace(fold(c), "(?iU)" + fixed.SHORT_NAME_NOISE, " ")), F.lit(" .,-/"))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def fingerprint(text: Column, model: Column | str, version: Column | str) -> Column:
    """Identity of an extraction: version, model and text. The context is not part of it."""
    model, version = (F.lit(x) if isinstance(x, str) else x for x in (model, version))
    return F.sha2(F.concat_ws("|", version, model, text), 256)


def citation(title: Column, section: Column, url: Column) -> Column:
    return F.concat(title, F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(" > "), section)).otherwise(""), F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit(" ("), url, F.lit(")"))).otherwise(""))


def words(c: Column) -> Column:
    """The folded words of a text, with an empty one where it begins or ends otherwise."""
    return F.split(fold(c), r"(?U)[^\w]+")


def terms(c: Column, stop: bool = True) -> Column:
    """The words of a text for lexical search: folded, without stop words."""
    found = F.filter(words(c), lambda w: w != "")
    return F.filter(found, lambda w: ~w.isin(*fixed.STOP_WORDS)) if stop else found


def sentences(c: Column) -> Column:
    return F.split(c, fixed.SENTENCE_BREAK)


def row_sentence(*columns: str) -> Column:
    """'name: value' of the filled columns of a row, joined by '; '."""
    cells = [F.when(F.trim(F.col(n).cast("string")) != "", F.concat(F.lit(f"{n}: "), F.col(n).cast("string"))) for n in columns]
    return F.concat_ws("; ", *cells)


def proper_nouns(c: Column) -> Column:
    """Capitalised words that don't begin the text, of three characters at least, without outer punctuation."""
    words = F.filter(F.split(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), " "), lambda w, i: (i > 0) & (F.substring(w, 1, 1).rlike(r"^\p{Lu}")) & (F.length(w) > 2))
    return F.transform(words, lambda w: F.btrim(w, F.lit(".,?!;:")))


def cited(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(fixed.CITATION), F.lit(1)), lambda n: n.cast("int"))


def coerce(c: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(c.isin(*allowed), c).otherwise(F.lit(default))


def host_allowed(url: Column, hosts: tuple[str, ...]) -> Column:
    """The host is one of hosts or under one of them."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    out = F.lit(False)
    for h in {h.strip().lower() for h in hosts if h.strip()}:
        out = out | (host == h) | host.endswith("." + h)
    return out
