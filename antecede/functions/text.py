"""Column functions for tolerant parsing and text normalisation; built-in expressions only."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean(col: str | Column) -> Column:
    """Trimmed text, blank becomes NULL."""
    return F.nullif(F.trim(_c(col)), F.lit(""))


def tolerant_int(col: str | Column) -> Column:
    """Integer part of a number given as text; anything else is NULL."""
    text = F.trim(_c(col))
    return F.when(text.rlike(_NUMBER), text.try_cast("double").try_cast("int"))


def nullable_decimal(col: str | Column, kind: str = "decimal(8,4)") -> Column:
    """Blank is NULL; other text must be a number."""
    return clean(col).cast(kind)


def decimal_or_null(col: str | Column, kind: str = "decimal(12,3)") -> Column:
    """Number or NULL; the caller quarantines the NULLs."""
    return clean(col).try_cast(kind)


def compact_date(col: str | Column) -> Column:
    return F.to_date(F.trim(_c(col)), "yyyyMMdd")


def utc_timestamp(col: str | Column) -> Column:
    """ISO text to an instant; text without an offset is UTC, whatever the session's time zone."""
    text = clean(col)
    zoned = F.when(text.endswith("Z"), text).when(text.rlike(r"[T ]\d{1,2}:\d{2}:\d{2}(\.\d+)?$"), F.concat(text, F.lit("Z"))).when(
        text.rlike(r"[T ]\d{1,2}:\d{2}$"), F.concat(text, F.lit(":00Z"))).when(
        text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.concat(text, F.lit("T00:00:00Z"))).otherwise(text)
    return zoned.try_cast("timestamp")


@lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str, dict[str, str], str]:
    """By rule from the Unicode tables: letters whose decomposition holds ASCII letters or digits.

    Returns single-letter sources and targets, multi-letter expansions, and a regex class of all
    combining marks.
    """
    sources, targets, longer, marks = [], [], {}, []
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        if 0xD800 <= code <= 0xDFFF:
            continue
        if unicodedata.combining(ch):
            marks.append(code)
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if plain != ch and any(c.isascii() and c.isalnum() for c in plain):
            if len(plain) == 1:
                sources.append(ch)
                targets.append(plain)
            else:
                longer[ch] = plain
    runs: list[list[int]] = []
    for code in marks:
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    ranges = "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in runs)
    return "".join(sources), "".join(targets), longer, f"[{ranges}]"


def _ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def strip_accents(col: str | Column) -> Column:
    """Compatibility decomposition without combining marks, as far as ASCII letters and digits go.

    ASCII text is returned as it is; accented Latin text needs one translation; only what is still not
    ASCII after that meets the expansion table and the class of combining marks.
    """
    sources, targets, longer, marks = _decompositions()
    plain = _c(col)
    text = F.translate(plain, sources, targets)
    wide = "[" + "".join(longer) + "]"
    table = F.from_json(F.lit(json.dumps(longer)), "map<string,string>")  # one literal, folded before the query runs
    letters = F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c))
    expanded = F.when(text.rlike(wide), F.array_join(letters, "")).otherwise(text)
    return F.when(_ascii(plain), plain).when(_ascii(text), text).otherwise(F.regexp_replace(expanded, marks, ""))


def fold_case(col: str | Column) -> Column:
    return F.replace(F.replace(F.lower(_c(col)), F.lit("ß"), F.lit("ss")), F.lit("ẞ"), F.lit("ss"))


def normalise_name(col: str | Column) -> Column:
    """Accents off, camel case split, case folded, every other character one space; never NULL."""
    text = strip_accents(F.trim(F.coalesce(_c(col), F.lit(""))))
    text = F.regexp_replace(text, "([a-z])(?=[A-Z])", "$1 ")
    return F.trim(F.regexp_replace(fold_case(text), "[^a-z0-9]+", " "))


def name_key(col: str | Column) -> Column:
    """Normalised name without spaces."""
    return F.replace(normalise_name(col), F.lit(" "), F.lit(""))


def name_aliases(normalised: str | Column) -> Column:
    """Array of aliases: the name itself; for every surname start, surname + initial both ways."""
    name = _c(normalised)
    tokens = F.split(name, " ")
    initial = F.substring(name, 1, 1)
    starts = F.when(F.size(tokens) >= 2, F.sequence(F.lit(2), F.size(tokens))).otherwise(F.array().cast("array<int>"))
    surnames = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.size(tokens)), " "))
    both = F.flatten(F.transform(surnames, lambda s: F.array(F.concat_ws(" ", s, initial), F.concat_ws(" ", initial, s))))
    return F.when(name == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.concat(F.array(name), both)))


def tour_label(col: str | Column) -> Column:
    # fixed values: the only tour labels that are recognised
    text = normalise_name(col)
    return F.when(text.isin("atp", "atp tour", "atp challenger", "challenger"), "ATP").when(
        text.isin("wta", "wta tour"), "WTA")


def side_of(*candidates: Column) -> Column:
    """First candidate naming a side: over or under as a whole word; else NULL."""
    return F.coalesce(*[
        F.nullif(F.regexp_extract(normalise_name(c), r"\b(over|under)\b", 1), F.lit("")) for c in candidates])


# fixed values: market names and the prop key each stands for, in order of precedence
PROP_NAMES = {
    "aces": "aces",
    "doublefaults": "double_faults",
    "double faults": "double_faults",
    "servicegames": "service_games",
    "service games": "service_games",
    "gameswon": "games_won",
    "games won": "games_won",
    "setswon": "sets_won",
    "sets won": "sets_won",
    "breakpointswon": "break_points_won",
    "break points won": "break_points_won",
    "minutes": "minutes",
}


def prop_key(col: str | Column, names: dict[str, str] | None = None) -> Column:
    """Whole name, then name without spaces, then first alias found as whole words; else NULL."""
    names = names or PROP_NAMES
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])

    def key(text: Column) -> Column:
        inside = [F.when(text.rlike(rf"\b{alias}\b"), F.lit(k)) for alias, k in names.items()]
        return F.coalesce(F.try_element_at(table, text),
                          F.try_element_at(table, F.replace(text, F.lit(" "), F.lit(""))), *inside)

    # the one-element array makes the text be normalised once, not once per alias
    return F.get(F.transform(F.array(normalise_name(col)), key), F.lit(0))


def title_label(col: str | Column) -> Column:
    """snake_case key to a display label."""
    return F.initcap(F.replace(_c(col), F.lit("_"), F.lit(" ")))


def version_stem(col: str | Column) -> Column:
    return F.split_part(_c(col), F.lit("_backtest_"), F.lit(1))


def model_family(col: str | Column) -> Column:
    version = _c(col)
    return F.when(version.like("baseline_v1_%"), "baseline").when(version.like("gbm_v1_%"), "GBM").when(
        version.like("ensemble_v1_%"), "ensemble").otherwise(version)
