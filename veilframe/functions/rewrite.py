"""Text rewrites, Column to Column: spoken forms to canonical text, and sweeping of what is left.

All are built-in expressions, null in, null out. Patterns are case-insensitive over Unicode.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import EMAIL_PROVIDERS, FILLERS, MONTHS, NUMBER_WORDS, ORDINAL_WORDS

MARKS = "\ue000\ue001\ue002\ue003"  # private-use code points, taken out of texts first
FLAGS = "(?iU)"


def once(value: Column, f) -> Column:
    """f of a value that is computed once, however often f, or a lambda in it, uses it."""
    return F.transform(F.array(value), f)[0]


def unmarked(text: Column) -> Column:
    """text with any of our marks replaced, one for one, so that offsets stay."""
    # Texts of one byte a character have none.
    return once(text, lambda t: F.when(F.octet_length(t) == F.char_length(t), t).otherwise(F.translate(t, MARKS, "\ufffd" * len(MARKS))))


def headed(pattern: str, first: str) -> str:
    """The pattern, tried only where a character of the class `first` is next; all its matches begin with one."""
    flags = re.match(r"(?:\(\?[a-zA-Z]+\))?", pattern).group()
    return rf"{flags}(?={first})(?:{pattern[len(flags):]})" if first else pattern


def escaped(value: Column) -> Column:
    """A pattern that matches the value itself."""
    return F.regexp_replace(value, r"(?U)([^\w\s])", r"\\$1")


def literal(replacement: str) -> str:
    """A replacement string without groups."""
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def _when_found(text: Column, pattern: str, changed: Column) -> Column:
    return F.when(text.rlike(pattern), changed).otherwise(text)


# -- spoken forms ---------------------------------------------------------------------------------
def normalize_number_words(text: Column) -> Column:
    """Runs of number words become their digits, joined."""
    mark = MARKS[0]
    word = headed(rf"{FLAGS}(?<!\w)(?:{'|'.join(NUMBER_WORDS)})(?!\w)", _initials(NUMBER_WORDS))
    known = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])

    def digits(found: Column) -> Column:
        # As patterns fold case: these also match s and i.
        return F.try_element_at(known, F.lower(F.translate(found, "\u017f\u0131\u0130", "sii")))

    def joined(parts: Column) -> Column:
        def between(p: Column, i: Column) -> Column:
            return F.when((i > 0) & (i < F.size(parts) - 1) & p.rlike(r"(?U)^\s+\z"), "").otherwise(p)

        return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, digits(p)).otherwise(between(p, i))), "")

    def change(marked: Column) -> Column:
        return F.when(F.contains(marked, F.lit(mark)), once(F.split(marked, mark, -1), joined))

    return once(text, lambda t: F.coalesce(once(F.regexp_replace(unmarked(t), word, f"{mark}$0{mark}"), change), t))


def normalize_separated_chars(text: Column) -> Column:
    """Single letters and digits in a row are joined."""
    return F.regexp_replace(text, r"(?U)(?=\s)(?<=\b[a-zA-Z0-9])\s+(?=[a-zA-Z0-9]\b)", "")


def normalize_email_addresses(text: Column, email_username_words: int = 2) -> Column:
    """'<words> at <domain> dot <ending>' becomes an address; its name has the last words before 'at'.

    A known provider gives the whole domain. Words before the name stay, single spaces between.
    """
    n = email_username_words
    more = max(n + 1, 4) - 1
    # The pattern of a spoken address.
    pattern = rf"{FLAGS}(?<!\w)(\w+(?:\s+\w+){{0,{more}}})\s+at\s+([a-zA-Z0-9.-]+(?:\s+[a-zA-Z0-9.-]+){{0,2}})\s+dot\s+([a-zA-Z]{{2,}})\b(?!\s+\w+\s+at)"
    if n:
        return once(text, lambda t: _when_found(t, rf"{FLAGS}(?=\s)\sat\s.*?\sdot\s", _addresses(t, n, pattern)))
    return _addresses(text, n, pattern)


def _addresses(text: Column, n: int, pattern: str) -> Column:
    a, b, c, d = MARKS
    parts = F.split(F.regexp_replace(unmarked(text), pattern, f"{a}$1{b}$2{c}$3{d}"), f"[{a}{d}]", -1)
    known = F.create_map(*[F.lit(x) for kv in EMAIL_PROVIDERS.items() for x in kv])

    def address(found: Column) -> Column:
        words = F.split(F.split_part(found, F.lit(b), F.lit(1)), r"(?U)\s+")
        host = F.split_part(found, F.lit(b), F.lit(2))
        domain = F.regexp_replace(F.lower(F.split_part(host, F.lit(c), F.lit(1))), r"(?U)\s+", "")
        whole = F.coalesce(F.try_element_at(known, domain), F.concat(domain, F.lit("."), F.lower(F.split_part(host, F.lit(c), F.lit(2)))))
        kept = F.greatest(F.size(words) - n, F.lit(0))
        own = F.concat(F.array_join(F.slice(words, kept + 1, F.lit(max(n, 1))), "."), F.lit("@"), whole)
        return F.when(kept > 0, F.concat(F.array_join(F.slice(words, F.lit(1), kept), " "), F.lit(" "), own)).otherwise(own)

    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, address(p)).otherwise(p)), "")


def remove_filler_words(text: Column, replacement: str = " ", keep_placeholder: bool = False) -> Column:
    """Fillers go, or become <FILLER>; then white space is single and none is at the ends."""
    out = text
    # One after the other only if a replacement could be a filler itself, or part of one.
    for pattern in ["|".join(FILLERS)] if keep_placeholder or not replacement.strip() else FILLERS:
        out = F.regexp_replace(out, headed(FLAGS + pattern, "[uhm]"), " <FILLER> " if keep_placeholder else literal(replacement))
    ends = r"(?U)^\s+|\s+\z"
    return once(F.regexp_replace(out, r"(?U)\s{2,}", " "), lambda t: F.when(F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1))).rlike(r"(?U)\s"), F.regexp_replace(t, ends, "")).otherwise(t))


def normalize_text(text: Column, email_username_words: int = 2, remove_fillers: bool = True) -> Column:
    """Number words, separated characters, addresses, fillers, in this order."""
    def change(t: Column) -> Column:
        out = normalize_email_addresses(normalize_separated_chars(normalize_number_words(t)), email_username_words)
        return F.when(t == "", t).otherwise(remove_filler_words(out) if remove_fillers else out)

    return once(text, change)


normalize_spelled_letters = normalize_separated_chars


def supported_email_providers() -> list[str]:
    return list(EMAIL_PROVIDERS)


# -- sweeping -------------------------------------------------------------------------------------
def _initials(words: Sequence[str]) -> str:
    return f"[{''.join(sorted({w[0] for w in words}))}]"


def sweep_months(text: Column, replacement: str = "<MONTH>") -> Column:
    return F.regexp_replace(text, headed(rf"{FLAGS}(?<!\w)(?:{'|'.join(MONTHS)})(?!\w)", _initials(MONTHS)), literal(replacement))


def sweep_ordinals(text: Column, replacement: str = "<GENERIC_NUMBER>") -> Column:
    """1st to 31st with any ending, and ordinal words."""
    # The pattern of ordinal numbers.
    out = F.regexp_replace(text, rf"{FLAGS}(?=[1-9])\b(?:[1-9]|[12][0-9]|3[01])(?:st|nd|rd|th)\b", literal(replacement))
    return F.regexp_replace(out, headed(rf"{FLAGS}(?<!\w)(?:{'|'.join(ORDINAL_WORDS)})(?!\w)", _initials(ORDINAL_WORDS)), literal(replacement))


def sweep_custom(text: Column, terms: Mapping[str, Sequence[str]] | None) -> Column:
    """Terms become their placeholders, in order of the mapping; of terms at one place the first listed wins."""
    out = text
    for placeholder, own in (terms or {}).items():
        if own:
            pattern = "|".join(re.sub(r"([^\w\s])", r"\\\1", t) for t in own)
            out = F.regexp_replace(out, rf"{FLAGS}\b(?:{pattern})\b", literal(placeholder))
    return out


def sweep_fields(text: Column, fields: Mapping[str, Sequence[Column]] | None) -> Column:
    """The values of a row's own columns become placeholders; null and blank values count for nothing."""
    out = text
    for placeholder, columns in (fields or {}).items():
        if not columns:
            continue
        values = F.transform(F.array(*[c.cast("string") for c in columns]), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+\z", ""))
        pattern = F.array_join(F.transform(F.filter(values, lambda x: x.isNotNull() & (x != "")), escaped), "|")

        out = once(F.struct(out.alias("t"), pattern.alias("p")), _swept(literal(placeholder)))
    return out


def _swept(placeholder: str):
    """Of a struct (t, p) t with the placeholder for the values of p, which are joined as a pattern."""
    return lambda s: F.when(s["p"] != "", F.regexp_replace(s["t"], F.concat(F.lit(rf"{FLAGS}\b(?:"), s["p"], F.lit(r")\b")), F.lit(placeholder))).otherwise(s["t"])


def sweep_text(
    text: Column, months: bool = True, ordinals: bool = True, custom: Mapping[str, Sequence[str]] | None = None, fields: Mapping[str, Sequence[Column]] | None = None, default: Mapping[str, Sequence[str]] | None = None
) -> Column:
    """Months, ordinals, fields, then the custom terms or, without any given, the default ones."""
    out = sweep_months(text) if months else text
    out = sweep_ordinals(out) if ordinals else out
    out = sweep_fields(out, fields)
    return sweep_custom(out, default if custom is None else custom)
