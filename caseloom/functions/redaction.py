"""Rule-based redaction: shield protected figures, redact, put the figures back."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from caseloom.constants import ADDRESS, EMAIL, PHONE, PROTECTED_FIGURE, REDACTED, SHIELD, pattern, python_class
from caseloom.functions.text import quote_regex


def email_pattern(unicode: bool = True) -> str:
    """The address pattern, matched in linear time.

    A match can only start where a run of local-part characters starts or right after the last
    match, and a run never gives characters back, so junk without ``@`` is read once.
    """
    local = pattern("[{w}.+-]", unicode)
    published = pattern(EMAIL, unicode)
    return rf"(?:\G|(?<!{local}))" + published.replace("+@", "++@", 1).replace("]+\\.", "]++\\.", 1)


def redact_addresses(text: Column, token: str = REDACTED) -> Column:
    """Postal addresses replaced. A number and a street word alone are none: words between them have to be capitalised."""
    return F.regexp_replace(text, pattern(ADDRESS), "$1" + replacement(token))


def phone_pattern(unicode: bool = True, strict: bool = False) -> str:
    """The phone pattern; ``strict`` adds bounds so it neither starts nor ends inside a number."""
    published = pattern(PHONE, unicode)
    if not strict:
        return published
    return pattern(r"(?<![{d}])", unicode) + published + pattern(r"(?![{d}])", unicode)


def entity_pattern(phrases: Sequence[str], flex_space: bool = False, unicode: bool = True) -> str | None:
    """One alternation of literal phrases that ignores case, longest first; None when empty. Phrases of white space
    alone are no phrases. With ``flex_space`` any run of white space stands for another."""
    space = re.compile(python_class("[{s}]+", unicode))
    kept = sorted({p for p in phrases if p and space.sub("", p)}, key=lambda p: (-len(p), p))
    if not kept:
        return None
    gap = pattern("[{s}]+", unicode)

    def literal(phrase: str) -> str:
        parts = [x for x in space.split(phrase) if x] if flex_space else [phrase]
        return (gap if flex_space else "").join(re.escape(part) for part in parts)

    return "(?iu)" + "|".join(literal(p) for p in kept)


def phrase_array_pattern(phrases: Column, flex_space: bool = False, unicode: bool = True) -> Column:
    """The same alternation built per row from an array of phrases; NULL when it is empty."""
    gap = pattern("[{s}]+", unicode)
    kept = F.filter(F.array_distinct(phrases), lambda p: F.regexp_replace(p, gap, "") != "")
    ordered = F.array_sort(F.transform(kept, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p"))))

    def literal(phrase: Column) -> Column:
        if not flex_space:
            return quote_regex(phrase)
        parts = F.filter(F.split(phrase, gap), lambda x: x != "")
        return F.array_join(F.transform(parts, quote_regex), gap)

    quoted = F.transform(ordered, lambda x: literal(x["p"]))
    return F.when(F.size(kept) > 0, F.concat(F.lit("(?iu)"), F.array_join(quoted, "|")))


def shield_pattern(protect: Sequence[str], unicode: bool = True) -> str | None:
    filled = [pattern(p, unicode) for p in protect]
    return "|".join(f"(?:{p})" for p in filled) if filled else None


def replacement(token: str) -> str:
    """The token as a replacement string, in which backslash and dollar are special."""
    return re.sub(r"([\\$])", r"\\\1", token)


def _scrub(text: Column, entities: str | Column | None, token: str, unicode: bool, strict: bool) -> Column:
    put = replacement(token)
    if isinstance(entities, str):
        text = F.regexp_replace(text, entities, put)
    elif entities is not None:
        text = F.when(entities.isNull(), text).otherwise(F.regexp_replace(text, entities, F.lit(put)))
    text = F.regexp_replace(text, email_pattern(unicode), put)
    return F.regexp_replace(text, phone_pattern(unicode, strict), put)


def redact(
    text: Column,
    entities: Sequence[str] | Column | None = None,
    protect: Sequence[str] = (PROTECTED_FIGURE,),
    *,
    token: str = REDACTED,
    unicode: bool = True,
    flex_space: bool = False,
    strict_phones: bool = False,
) -> Column:
    """Redact known phrases, addresses and phone numbers; protected figures survive untouched.

    ``entities`` is a list of phrases, or a Column holding one regular expression per row (NULL:
    none) such as `phrase_array_pattern` gives. NULL and empty texts become ''. Rows without a
    protected figure, nearly all of them, take the plain chain of replacements.
    """
    known = entities if isinstance(entities, Column) else entity_pattern(entities or (), flex_space, unicode)
    text = F.coalesce(text, F.lit(""))
    plain = _scrub(text, known, token, unicode, strict_phones)
    shield = shield_pattern(protect, unicode)
    if shield is None:
        return plain

    before, after = SHIELD.split("{}")

    def marker(index: Column) -> Column:
        return F.concat(F.lit(before), index.cast("string"), F.lit(after))

    figures = F.regexp_extract_all(text, F.lit(shield), F.lit(0))
    pieces = F.split(text, shield, -1)
    shielded = F.array_join(
        F.transform(pieces, lambda piece, i: F.when(i == 0, piece).otherwise(F.concat(marker(i - 1), piece))),
        "",
    )
    numbered = F.transform(figures, lambda figure, i: F.struct(marker(i).alias("mark"), figure.alias("figure")))
    restored = F.aggregate(
        numbered,
        _scrub(shielded, known, token, unicode, strict_phones),
        lambda done, x: F.replace(done, x["mark"], x["figure"]),
    )
    return F.when(F.rlike(text, F.lit(shield)), restored).otherwise(plain)
