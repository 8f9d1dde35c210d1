"""Language votes as Column functions.

A token votes for every language whose marker words contain it, and for the language of
its script (Devanagari, Arabic). The most votes win; ties go to the alphabetically first
code, so the answer never depends on chance.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textwarden import config

# Code points a token may start with, by script: first ones and the ones after the last.
ARABIC = ((0x0600, 0x0700), (0x0750, 0x0780))
DEVANAGARI = ((0x0900, 0x0980),)

# Letters or words that tell the languages sharing a script apart.
URDU_LETTERS = "[ٹڈڑںھہے]"
PERSIAN_LETTERS = "[پچژگکی]"
MARATHI_SIGNS = r"ळ|(?:^|[^\p{L}\p{M}])(?:आहे|आहेत|आणि|नाही)(?:$|[^\p{L}\p{M}])"
NEPALI_SIGNS = r"(?:^|[^\p{L}\p{M}])(?:छ|छन्|भएको|गर्ने)(?:$|[^\p{L}\p{M}])"

# Languages told by their script; a profile of marker words covers others.
SCRIPT_LANGUAGES = ("ar", "fa", "hi", "mr", "ne", "ur")


def markers(profile: Mapping[str, Sequence[str]]) -> tuple[str, ...]:
    return tuple(sorted({word for words in profile.values() for word in words}))


def quoted(words: Iterable[str]) -> str:
    """Words as a list of SQL string literals."""
    return ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)


def kept(tokens: str, words: Sequence[str]) -> str:
    """SQL for the tokens of an array that are among ``words`` (a hash-set lookup each).

    Word lists are written as SQL text, since a column object per word would make building
    the query slow.
    """
    if not words:
        return "cast(array() as array<string>)"
    return f"filter({tokens}, t -> t in ({quoted(words)}))"


def keep(tokens: str, words: Sequence[str]) -> Column:
    return F.expr(kept(tokens, words))


def starts_in(token: str, *scripts: Sequence[tuple[int, int]]) -> str:
    """SQL for a token starting in a script. Strings compare by code point, so this needs no
    search, and for Latin tokens it ends at the first comparison."""
    ranges = [pair for script in scripts for pair in script]
    lowest = min(first for first, _ in ranges)
    within = [f"({token} >= '{chr(first)}' and {token} < '{chr(end)}')" for first, end in ranges]
    return f"({token} >= '{chr(lowest)}' and ({' or '.join(within)}))"


def known_tokens(tokens: str, words: Sequence[str]) -> Column:
    """Tokens that can count: those among ``words`` and those in another script."""
    other = starts_in("t", ARABIC, DEVANAGARI)
    among = f"t in ({quoted(words)}) or " if words else ""
    return F.expr(f"filter({tokens}, t -> {among}{other})")


SIGN_SHARE = 5
"""One token in so many must hold a language's own letters; a stray letter decides nothing."""


def devanagari_language(text: Column) -> Column:
    return F.when(text.rlike(MARATHI_SIGNS), "mr").when(text.rlike(NEPALI_SIGNS), "ne").otherwise("hi")


def script_votes(text: Column, known: str) -> Column:
    """Struct of the two script votes, null for texts whose tokens all come before these scripts.

    ``known`` names the array column made by :func:`known_tokens`.
    """

    def tokens_in(*scripts: Sequence[tuple[int, int]]) -> str:
        return f"filter({known}, t -> {starts_in('t', *scripts)})"

    def own_letters(letters: str) -> Column:
        held = f"size(filter({tokens_in(ARABIC)}, t -> t rlike '{letters}'))"
        return F.expr(f"{SIGN_SHARE} * {held} >= size({tokens_in(ARABIC)}) and {held} > 0")

    return F.when(
        F.array_max(known) >= chr(ARABIC[0][0]),
        F.struct(
            F.expr(f"size({tokens_in(ARABIC)})").alias("arabic"),
            F.when(own_letters(URDU_LETTERS), "ur")
            .when(own_letters(PERSIAN_LETTERS), "fa")
            .otherwise("ar")
            .alias("arabic_lang"),
            F.expr(f"size({tokens_in(DEVANAGARI)})").alias("devanagari"),
            devanagari_language(text).alias("devanagari_lang"),
        ),
    )


def ballot(hits: str, script: str, profile: Mapping[str, Sequence[str]]) -> Column:
    """Array of ``(rank, lang)`` with rank = -votes, one entry per possible language.

    ``hits`` names the array column made by :func:`known_tokens`, ``script`` the column made by
    :func:`script_votes`.
    """

    def entry(votes: str, lang: str) -> str:
        return f"named_struct('rank', -({votes}), 'lang', {quoted([lang])})"

    marker = [entry(f"size({kept(hits, words)})", lang) for lang, words in profile.items()]
    by_script = [
        entry(
            f"if({script}.arabic_lang = '{lang}', {script}.arabic, 0)"
            f" + if({script}.devanagari_lang = '{lang}', {script}.devanagari, 0)",
            lang,
        )
        for lang in SCRIPT_LANGUAGES
        if lang not in profile
    ]
    voted, other = f"array({', '.join(marker)})", f"array({', '.join(by_script)})"
    if not (marker and by_script):
        return F.expr(voted if marker else other)
    return F.expr(f"if({script} is null, {voted}, concat({voted}, {other}))")


def leader(ballot_col: Column) -> Column:
    """Entry with the most votes; the alphabetically first of equals."""
    return F.array_min(ballot_col)


def winner(best: Column) -> Column:
    """Code of the leading entry, ``unknown`` if nothing voted."""
    return F.when(best["rank"] < 0, best["lang"]).otherwise(config.UNKNOWN_LANGUAGE)


def literal_map(values: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(part) for pair in values.items() for part in pair])


def alias_of(code: Column, settings: config.Settings) -> Column:
    """Alias target of a code, or the code itself."""
    return F.coalesce(literal_map(settings.aliases)[code], code) if settings.aliases else code


def supported_language(raw: Column, settings: config.Settings) -> Column:
    mapped = alias_of(raw, settings)
    return F.when(mapped.isin(list(settings.supported)), mapped).otherwise(settings.fallback)


def candidates(ballot_col: Column, settings: config.Settings) -> Column:
    """Languages with votes, best first: ``array<struct<lang, mapped_to, confidence>>``."""
    voted = F.sort_array(F.filter(ballot_col, lambda v: v["rank"] < 0))
    total = F.aggregate(voted, F.lit(0), lambda acc, v: acc + v["rank"])
    return F.transform(
        voted,
        lambda v: F.struct(
            v["lang"].alias("lang"),
            alias_of(v["lang"], settings).alias("mapped_to"),
            F.round(v["rank"] / total, 4).alias("confidence"),
        ),
    )
