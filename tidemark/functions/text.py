"""Text normalisation and edit distances as column expressions."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.binding import let

# Edits up to which distances are first sought; each search costs about as much as all before it.
BANDS = (16, 128, 1_024, 8_192, 65_536)


def collapse_whitespace(text: Column) -> Column:
    """Join the Unicode whitespace-separated words with single spaces."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


# Fixed values of the character reference rules: numbers that stand for Windows characters, and the
# longest name that needs no semicolon.
_WINDOWS = "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0))
_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_OPEN_NAMES = {name: sign for name, sign in html5.items() if not name.endswith(";")}
_LONGEST_OPEN = max(map(len, _OPEN_NAMES))


def _names(table: dict[str, str]) -> Column:
    """Look-up table of names by their first two letters, as one literal."""
    grouped: dict[str, dict[str, str]] = {}
    for name, sign in table.items():
        grouped.setdefault(name[:2], {})[name] = sign
    return F.from_json(F.lit(json.dumps(grouped)), "map<string,map<string,string>>")


def _looked_up(table: Column, name: Column) -> Column:
    return table[F.substring(name, 1, 2)][name]


def _character(number: Column) -> Column:
    """The character of a code point, as long as there is one."""
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def _numeric(reference: Column) -> Column:
    """What ``#123;`` or ``#x1F;`` stands for."""
    is_hex = F.lower(F.substring(reference, 2, 1)) == "x"
    digits = F.regexp_replace(F.regexp_replace(reference, "^#[xX]?0*", ""), ";$", "")
    # More than seven digits are beyond the last code point in either base.
    number = F.when(F.length(digits) > 7, F.lit(1 << 30)).otherwise(
        F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
    )

    def sign(n: Column) -> Column:
        unknown = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
        dropped = (
            n.between(0x1, 0x8) | (n == 0xB) | n.between(0xE, 0x1F) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF)
            | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        )
        return (
            F.when(unknown, "�").when(n.between(0x80, 0x9F), F.substring(F.lit(_WINDOWS), n - 0x7F, F.lit(1)))
            .when(dropped, "").otherwise(_character(n))
        )

    return let(F.coalesce(number, F.lit(0)), sign)


def unescape(text: Column) -> Column:
    """Resolve all named and numeric character references inside the JVM.

    A name is read as far as one is known, so that some names need no semicolon; what is no reference
    stays. Texts without ``&`` are passed on untouched.
    """
    exact, open_names = _names(html5), _names(_OPEN_NAMES)

    def resolved(piece: Column) -> Column:
        return let(
            F.regexp_extract(piece, _REFERENCE, 1),
            lambda name: F.concat(sign_of(name), F.substring(piece, F.length(name) + 1, F.length(piece))),
        )

    def begins(name: Column, n: int) -> Column:
        start = F.substring(name, 1, n)
        known = F.concat(_looked_up(open_names, start), F.substring(name, F.lit(n + 1), F.length(name)))
        return F.when(F.length(name) >= n, known)

    def sign_of(name: Column) -> Column:
        beginnings = [begins(name, n) for n in range(_LONGEST_OPEN, 1, -1)]
        named = F.coalesce(_looked_up(exact, name), *beginnings, F.concat(F.lit("&"), name))
        return F.when(name.startswith("#"), _numeric(name)).otherwise(named)

    pieces = F.split(text, "&")
    tail = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), resolved)
    whole = F.concat(F.get(pieces, F.lit(0)), F.array_join(tail, ""))
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def unescape_basic(text: Column) -> Column:
    """Resolve the five XML entities inside the JVM, ``&amp;`` last."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def normalise_text(text: Column, markup: bool = True, entities: str = "full") -> Column:
    """Normalised cue text (``markup``) or normalised region text (whitespace only).

    ``entities='full'`` resolves every named and numeric reference, ``'basic'`` the five of XML.
    """
    if markup:
        text = F.regexp_replace(text, "<[^>]*>", "")
        text = unescape(text) if entities == "full" else unescape_basic(text)
    return collapse_whitespace(text)


def words(text: Column) -> Column:
    """Whitespace tokens without empty strings."""
    return F.filter(F.split(collapse_whitespace(text), " "), lambda w: w != "")


def _leading_matches(left: Column, right: Column, keep: int) -> Column:
    """How many leading elements two arrays share, leaving ``keep`` elements on either side."""
    same = F.zip_with(left, right, lambda a, b: F.coalesce(a == b, F.lit(False)))
    room = F.greatest(F.least(F.size(left), F.size(right)) - keep, F.lit(0))
    return let(
        F.array_position(same, F.lit(False)).cast("int"),
        lambda first: F.least(F.when(first > 0, first - 1).otherwise(room), room),
    )


def _differing_middle(left: Column, right: Column, keep: int, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` on two arrays without their shared head and tail, which no edit ever touches."""
    def drop(values: Column, count: Column) -> Column:
        return F.slice(values, count + 1, F.greatest(F.size(values) - count, F.lit(0)))

    def pair(a: Column, b: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"))

    def without_head(p: Column) -> Column:
        return let(
            _leading_matches(p["a"], p["b"], keep), lambda n: pair(drop(p["a"], n), drop(p["b"], n))
        )

    def turned(p: Column) -> Column:
        return pair(F.reverse(p["a"]), F.reverse(p["b"]))

    return let(
        pair(left, right),
        lambda p: let(
            turned(without_head(p)),
            lambda r: let(turned(without_head(r)), lambda m: body(m["a"], m["b"])),
        ),
    )


def _levenshtein(left: Column, right: Column) -> Column:
    """Exact distance, sought in wider and wider bands: the work is length times distance."""
    tried = [let(F.levenshtein(left, right, band), lambda d: F.when(d >= 0, d)) for band in BANDS]
    return F.coalesce(*tried, F.levenshtein(left, right))


def edit_distance(left: Column, right: Column) -> Column:
    """Exact Levenshtein distance over code points.

    Only the stretch between the first and the last differing word is compared, so near copies of
    long texts cost little; at least one word stays on either side, with its spaces. The stretch is
    compared in bands that widen until they hold the distance.
    """
    distance = _differing_middle(
        F.split(left, " "), F.split(right, " "), 1,
        lambda a, b: let(
            F.struct(F.array_join(a, " ").alias("a"), F.array_join(b, " ").alias("b")),
            lambda t: _levenshtein(t["a"], t["b"]),
        ),
    )
    return F.when(left.isNotNull() & right.isNotNull(), distance).cast("long")


def word_edit_distance(left: Column, right: Column) -> Column:
    """Exact Levenshtein distance over word arrays.

    The words between the shared head and tail are numbered within their pair, written as private
    code points and compared as strings, in widening bands. Code points start at U+4E00 and skip the
    surrogate range. Many words are numbered inside groups by hash, so that finding a word's number
    does not take longer the more words there are.
    """
    groups, many = 256, 2_048

    def group_of(word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(groups)).cast("int")

    def written(values: Column, number: Callable[[Column], Column]) -> Column:
        def sign(word: Column) -> Column:
            at = number(word) + F.lit(0x4DFF)
            return _character(F.when(at >= 0xD800, at + 0x800).otherwise(at))

        return F.array_join(F.transform(values, sign), "")

    def grouped(names: Column) -> Column:
        def by_hash(placed: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(0), F.lit(groups - 1)),
                lambda g: F.transform(F.filter(placed, lambda p: p["g"] == g), lambda p: p["w"]),
            )

        placed = F.transform(names, lambda w: F.struct(group_of(w).alias("g"), w.alias("w")))
        return F.when(F.size(names) <= many, F.array(names)).otherwise(let(placed, by_hash))

    def number_in(table: Column) -> Callable[[Column], Column]:
        def number(word: Column) -> Column:
            one = F.size(table) == 1
            g = F.when(one, F.lit(0)).otherwise(group_of(word))
            place = F.array_position(F.get(table, g), word)
            return F.when(one, place).otherwise((place - 1) * groups + g + 1)

        return number

    def compare(a: Column, b: Column) -> Column:
        one_sided = (F.size(a) == 0) | (F.size(b) == 0)
        return F.when(one_sided, F.size(a) + F.size(b)).otherwise(both(a, b))

    def both(a: Column, b: Column) -> Column:
        return let(
            grouped(F.array_distinct(F.concat(a, b))),
            lambda table: let(
                F.struct(written(a, number_in(table)).alias("a"), written(b, number_in(table)).alias("b")),
                lambda t: _levenshtein(t["a"], t["b"]),
            ),
        )

    return _differing_middle(left, right, 0, compare).cast("long")
