"""Text expressions: whitespace, entities, counting and term tests."""

from __future__ import annotations

import html.entities
import re
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four separators U+001C..U+001F.
SPACE = r"[\s\x1c-\x1f]"
NON_SPACE = r"[^\s\x1c-\x1f]"

def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Name a value inside an expression, so that it is written, and computed, once however often it is used.

    Catalyst copies a projected expression into every filter it pushes below the projection; without this, expressions
    that mention a costly value many times grow with each such copy.
    """
    return F.transform(F.array(value), use)[0]


def collapse_spaces(c: Column) -> Column:
    """One space for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def strip(c: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(c, rf"(?U)\A{SPACE}++|(?<!{SPACE}){SPACE}++\z", "")


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(rf"(?U){NON_SPACE}+"))


def sentence_mark_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[.!?]+"))


def contains_any(c: Column, terms: Iterable[str]) -> Column:
    """True if any term occurs as a plain substring."""
    return reduce(lambda a, b: a | b, [c.contains(t) for t in terms], F.lit(False))


def matches(c: Column, pattern: str) -> Column:
    """Whether a pattern occurs. Patterns that are only a choice of plain texts become byte searches."""
    if re.fullmatch(r"[\w \-]+(\|[\w \-]+)*", pattern):
        return contains_any(c, pattern.split("|"))
    return c.rlike(f"(?U){pattern}")


def first_contained(c: Column, terms: Iterable[str]) -> Column:
    """The first term, in list order, that occurs as a substring; null if none does."""
    tests = [F.when(c.contains(t), F.lit(t)) for t in terms]
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def occurrences(c: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("int")


def any_word_pattern(names: Sequence[str]) -> str:
    return r"(?iU)\b(?:" + "|".join(re.escape(n) for n in names) + r")\b"


def first_word_match(c: Column, names: Sequence[str]) -> Column:
    """First name, in list order, found as a whole word in any case.

    One pass with all names decides whether there is a hit at all; only then is each name tried in turn.
    """
    if not names:
        return F.lit(None).cast("string")
    ladder = F.coalesce(*[F.when(c.rlike(rf"(?iU)\b{re.escape(n)}\b"), F.lit(n)) for n in names])
    return F.when(c.rlike(any_word_pattern(names)), ladder)


# What HTML reads for a number in the C1 range: the character of that byte in Windows-1252, where it has one.
_WINDOWS = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
_REFERENCE = r"^(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);?"


def _table(entries: dict[str, str]) -> Column:
    return F.map_from_arrays(*[F.split(F.lit("\x01".join(x)), "\x01") for x in (entries.keys(), entries.values())])


def _code_point(reference: Column) -> Column:
    """The character of ``#10`` or ``#xA``; zero, surrogates and what is beyond Unicode are U+FFFD."""
    hexadecimal = reference.rlike("^#[xX]")
    digits = F.regexp_replace(reference, "^#[xX]?0*", "")
    number = F.when(
        F.length(digits) <= 7, F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
    )
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    windows = F.element_at(F.array(*map(F.lit, _WINDOWS.values())), (number - 0x7F).cast("int"))
    char = F.when(number.between(0x80, 0x9F), windows).otherwise(
        F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    )
    return F.when(valid, char).otherwise(F.lit("\ufffd"))


def _decode(c: Column, attribute: bool) -> Column:
    """Every reference is replaced once: a text is split at its ampersands, and each piece begins with at most one.

    A name with a semicolon is looked up whole. Without one, or if there is no such name, the longest old name that the
    piece begins with counts, as HTML has it; not so in an attribute if a letter, a digit or ``=`` follows.
    """
    names = html.entities.html5
    table = _table({name[:-1]: char for name, char in names.items() if name.endswith(";")})
    old = sorted((name for name in names if not name.endswith(";")), key=len, reverse=True)
    short = rf"^({'|'.join(old)})" + (r"(?![a-zA-Z0-9=])" if attribute else "")

    def numeric(piece: Column, name: Column) -> Column:
        ended = F.substr(piece, F.length(name) + 1, F.lit(1)) == ";"
        return F.concat(_code_point(name), F.substr(piece, F.length(name) + 1 + ended.cast("int")))

    def named(piece: Column, name: Column) -> Column:
        whole = F.when(
            F.substr(piece, F.length(name) + 1, F.lit(1)) == ";",
            F.concat(F.try_element_at(table, name), F.substr(piece, F.length(name) + 2)),
        )
        part = let(
            F.regexp_extract(piece, short, 1),
            lambda n: F.concat(F.try_element_at(table, n), F.substr(piece, F.length(n) + 1)),
        )
        return F.coalesce(whole, part)

    def read(piece: Column, i: Column) -> Column:
        decoded = let(
            F.regexp_extract(piece, _REFERENCE, 1),
            lambda name: F.when(name.startswith("#"), numeric(piece, name)).when(name != "", named(piece, name)),
        )
        return F.when(i == 0, piece).otherwise(F.coalesce(decoded, F.concat(F.lit("&"), piece)))

    return F.array_join(F.transform(F.split(c, "&"), read), "")


def decode_entities(c: Column, attribute: bool = False) -> Column:
    """HTML character references to characters; text without ``&`` passes through untouched."""
    return let(c, lambda t: F.when(t.contains("&"), _decode(t, attribute)).otherwise(t))


def strip_tags(c: Column, joiner: str = "") -> Column:
    return F.regexp_replace(c, r"<[^>]*>", joiner)
