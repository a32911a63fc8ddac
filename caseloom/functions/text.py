"""Column -> Column text functions. All of them are built-in Spark expressions."""

from __future__ import annotations

import functools
import re
import sys

from pyspark.sql import Column, functions as F

from caseloom.constants import HTML_TAG, UNSAFE_NAME_CHAR, pattern, python_class


@functools.cache
def space_letters(unicode: bool = True) -> str:
    """All letters of the class of white space."""
    return "".join(re.findall(python_class("[{s}]", unicode), "".join(map(chr, range(0x3001)))))


def strip_text(text: Column, unicode: bool = True) -> Column:
    """Remove leading and trailing white space of every kind (``trim`` alone only removes blanks). Only the ends are read."""
    return F.trim(text, F.lit(space_letters(unicode)))


def strip_html(html: Column) -> Column:
    """Each tag becomes one blank; entities and script bodies stay; NULL stays NULL.

    A tag can only be the first ``<`` since the last ``>``. So the search starts there and nowhere
    else, and a page full of ``<`` without an end is read once.
    """
    tag = HTML_TAG.replace("]+", "]++")
    return strip_text(F.regexp_replace(html, rf"(?:\G|(?<=>))([^<>]*+){tag}", "$1 "))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(name: Column) -> Column:
    """The part from the last dot on, case kept; leading dots do not start one."""
    return F.regexp_extract(name, r"(?s)^\.*[^.].*(\.[^.]*)$", 1)


def extension(name: Column) -> Column:
    return F.lower(suffix(name))


def stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def safe_name(raw_name: Column, position: Column, unicode: bool = True) -> Column:
    """Attachment name safe for a file system; empty results take the position in the email."""
    fallback = F.concat(F.lit("attachment_"), position.cast("string"))
    name = basename(F.coalesce(F.when(raw_name != "", raw_name), fallback))
    clean = F.regexp_replace(name, pattern(UNSAFE_NAME_CHAR, unicode), "_")
    clean = F.regexp_replace(clean, r"\A_+|(?<!_)_+\z", "")
    return F.when(clean == "", fallback).otherwise(clean)


def strip_fence(text: Column) -> Column:
    """Remove one outer Markdown code fence, if the text starts with it."""
    body = strip_text(text)
    opened = F.regexp_replace(body, r"\A[^\n]*\n", "")
    closed = F.regexp_replace(opened, r"```\z", "")
    return strip_text(F.when(F.startswith(body, F.lit("```")), closed).otherwise(body))


def first_block(blocks: Column, kind: str) -> Column:
    """First element of an array of typed blocks with ``type = kind``; NULL when there is none."""
    return F.get(F.filter(blocks, lambda block: block["type"] == kind), F.lit(0))


def reply_text(blocks: Column) -> Column:
    """Text of the first text block; NULL (an error to handle) when there is none."""
    return first_block(blocks, "text")["text"]


def lookup(mapping: Column, key: Column, default: Column) -> Column:
    """Map lookup with a default."""
    return F.coalesce(F.try_element_at(mapping, key), default)


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def fixed(number: Column, digits: int) -> Column:
    """A number with fixed decimals, rounded by its exact binary value."""
    return F.replace(F.format_number(number.cast("double"), digits), F.lit(","), F.lit(""))


def dollars(amount: Column) -> Column:
    return F.concat(F.lit("$"), fixed(amount, 4))


def percent(value: Column) -> Column:
    return F.concat(fixed(value, 1), F.lit("%"))


def quote_regex(text: Column) -> Column:
    """The text as a regular expression that matches it literally."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def words(text: Column, unicode: bool = True) -> Column:
    """White-space separated words of a text; an empty text has none."""
    split = F.split(strip_text(text, unicode), pattern("[{s}]+", unicode))
    return F.filter(split, lambda word: word != "")


def _folded(letter: str) -> str:
    """The lower form of the upper form, each of one letter, as patterns that ignore case compare letters."""
    upper = next((x for x in (letter.upper(), letter.title()) if len(x) == 1), letter)
    return upper.lower()[0]


@functools.cache
def _beyond_lower() -> tuple[str, str]:
    """(letters whose folded form isn't what ``lower`` makes of them wherever they stand, their folded forms)."""
    letters = [c for c in map(chr, range(128, sys.maxunicode + 1)) if c.lower() != c or c.upper() != c]
    found = [c for c in letters if _folded(c) != c.lower() or c == "\u03a3"]
    return "".join(found), "".join(map(_folded, found))


def fold_case(text: Column) -> Column:
    """Case-folded form used for comparisons that ignore case: equal wherever a pattern that ignores case is.

    ``lower`` alone misses letters that only share their upper form (long s and s), and hangs on the place of a final
    sigma. A chain of ``upper`` and ``lower`` would not do: the optimizer drops the inner one. So those letters, a few
    dozen by rule, are replaced first.
    """
    return F.lower(F.translate(text, *_beyond_lower()))
