"""Detection and redaction by declarative recognizers; a model's spans can be added as a column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.constants import ENTITIES, STATES, STREETS


@dataclass(frozen=True)
class Recognizer:
    """An entity's patterns (name, regular expression, score). `needs` is a cheap pattern that any match contains, `first` a class that its
    first character is in; `parts` has a text for each pattern that its matches contain."""

    entity: str
    patterns: tuple[tuple[str, str, float], ...]
    context: tuple[str, ...] = ()
    needs: str = ""
    luhn: bool = False
    first: str = ""
    parts: tuple[str, ...] = ()


# The number, phone and address patterns with their scores.
_STREET = r"\b\d{1,3}\s+(?:[A-Za-z]+\s+){1,5}(?:" + "|".join(STREETS) + r")\b"
AU_PHONE = Recognizer(
    "AU_PHONE_NUMBER",
    (
        ("au_landline", r"(?U)\b0[2-9]\s?\d{4}\s?\d{4}\b", 0.85),
        ("au_mobile_standard", r"(?U)\b04\d{2}\s?\d{3}\s?\d{3}\b", 0.9),
        ("au_mobile_compact", r"(?U)\b04\d{8}\b", 0.9),
        ("au_international", r"(?U)(?<!\w)\+61\s?[2-9]\s?\d{4}\s?\d{4}\b", 0.95),
        ("au_synthetic", r"(?U)\b04\d{4}\s?\d{3}\s?\d{3}\b", 0.7),
    ),
    ("phone", "mobile", "cell", "number", "call"),
    needs=r"(?U)\d{3}",
    first="[0+]",
    parts=("0", "04", "04", "+61", "04"),
)
GENERIC_NUMBER = Recognizer(
    "GENERIC_NUMBER",
    (
        ("eight_digit_sequence", r"(?U)\b\d{8}\b", 1.0),
        ("any_digit_sequence", r"(?U)\b\d{1,16}\b", 0.9),
        ("formatted_numbers", r"(?U)\b\d{1,3}(?:,\d{3})+\b", 0.65),
        ("decimal_numbers", r"(?U)\b\d+\.\d+\b", 0.65),
    ),
    ("number", "digit", "id", "member", "account"),
    needs=r"(?U)\d",
    first=r"\d",
)
AU_ADDRESS = Recognizer(
    "AU_ADDRESS",
    (
        ("australian_street_address", rf"(?iU){_STREET},?\s*(?:[A-Za-z]+\s+){{1,3}}(?:{'|'.join(STATES)})\s+\d{{4}}\b", 0.95),
        ("australian_street_simple", rf"(?iU){_STREET}", 0.7),
    ),
    needs=r"(?U)\d\s+[A-Za-z]",
    first=r"\d",
)
# The member number patterns with their scores.
MEMBER_NUMBER = Recognizer("MEMBER_NUMBER", (("member_number_8_digits", r"(?U)\b\d{8}\b", 0.9), ("member_number_with_spaces", r"(?U)\b\d{4}\s?\d{4}\b", 0.85)), needs=r"(?U)\d{4}", first=r"\d")

# Our own rules for the types that a library or a model would find.
EMAIL = Recognizer("EMAIL_ADDRESS", (("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 1.0),), needs="@")
PHONE = Recognizer(
    "PHONE_NUMBER",
    (
        ("with_area", r"(?U)(?<![\w+])(?:\+\d{1,3}[ -]?)?\(\d{2,3}\)[ -]?\d{3,4}[ -]?\d{4}(?!\w)", 0.75),
        ("international", r"(?U)(?<![\w+])\+\d{1,3}(?:[ -]?\d{2,4}){2,4}(?!\w)", 0.75),
        ("mobile", r"(?U)(?<!\w)04\d{2}[ -]?\d{3}[ -]?\d{3}(?!\w)", 0.75),
    ),
    needs=r"(?U)\d{3}",
    first="[(+0]",
    parts=("(", "+", "04"),
)
CREDIT_CARD = Recognizer("CREDIT_CARD", (("card", r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", 1.0),), needs=r"[0-9]{2}", luhn=True, first="[0-9]")
_CITIES = ("Sydney", "Melbourne", "Brisbane", "Perth", "Adelaide", "Hobart", "Darwin", "Canberra", "Newcastle", "Geelong", "Cairns", "Townsville")
LOCATION = Recognizer("LOCATION", (("city", rf"(?U)\b(?:{'|'.join(_CITIES)})\b", 0.6),), needs="[A-Z]", first="[A-Z]")
PERSON = Recognizer("PERSON", (("cue", r"(?U)(?<=\b(?:[Mm]y name is|[Nn]ame is|[Tt]his is|I am|I'm|Mr\.?|Mrs\.?|Ms\.?|Dr\.?)\s)[A-Z][a-z]+(?:\s[A-Z][a-z]+){0,2}\b", 0.6),), needs="[A-Z]", first="[A-Z]")

DEFAULT = (PERSON, EMAIL, PHONE, LOCATION, CREDIT_CARD, AU_PHONE, AU_ADDRESS, GENERIC_NUMBER)


def people(names: Sequence[str], score: float = 0.85) -> Recognizer:
    """A recognizer of listed names."""
    import re

    return Recognizer("PERSON", (("listed", rf"(?iU)\b(?:{'|'.join(map(re.escape, names))})\b", score),))


def detect(text: Column, recognizers: Sequence[Recognizer] = DEFAULT, entities: Sequence[str] | None = ENTITIES, context: float = 0.0) -> Column:
    """An array of spans by type, then place. With `context`, scores rise by it (up to 1) where a text has one of the type's context words."""
    use = [r for r in recognizers if entities is None or r.entity in entities]

    def own(r: Recognizer, t: Column) -> Column:
        every = [S.find_spans(t, p, r.entity, score, r.first, clean=True) for _, p, score in r.patterns]
        out = F.concat(*[F.when(F.contains(t, F.lit(part)), x).otherwise(S.none()) if part else x for x, part in zip_longest(every, r.parts, fillvalue="")])
        if r.luhn:
            out = F.filter(out, lambda s: F.call_function("luhn_check", F.regexp_replace(s["text"], "[^0-9]", "")))
        out = S.within_type(out) if len(r.patterns) > 1 else out
        if context and r.context:
            more = F.when(F.lower(t).rlike(rf"(?U)\b(?:{'|'.join(r.context)})\b"), F.lit(context)).otherwise(F.lit(0.0))
            out = F.transform(out, lambda s: s.withField("score", F.least(F.lit(1.0), s["score"] + more)))
        return F.when(t.rlike(r.needs), out).otherwise(S.none()) if r.needs else out

    return S.once(S.unmarked(text), lambda t: F.concat(*[own(r, t) for r in use])) if use else S.none()


def _counters(detections: Column) -> Column:
    return F.struct(
        F.size(F.filter(detections, lambda s: s["entity_type"] == "MEMBER_NUMBER")).alias("member_numbers"),
        F.size(F.filter(detections, lambda s: s["entity_type"].isin("AU_ADDRESS", "LOCATION"))).alias("addresses"),
    )


def detect_and_redact(df: DataFrame, text_col: str = "call_transcript", recognizers: Sequence[Recognizer] = DEFAULT, entities: Sequence[str] | None = ENTITIES, extra: str | None = None, context: float = 0.0) -> DataFrame:
    """df with pii_detections, anonymized_text, pii_count, custom_detections and workflow, in one narrow pass.

    `extra` names a column of spans found elsewhere, as by a model. A null text has no detections and stays null.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.withColumn("pii_detections", F.concat(detect(text, recognizers, entities, context), *([F.coalesce(F.col(extra), S.none())] if extra else [])))
    out = out.withColumn("_kept", S.resolve(F.col("pii_detections")))
    return out.withColumns(
        {"anonymized_text": S.redact(F.col(text_col), F.col("_kept")), "pii_count": F.size("pii_detections"), "custom_detections": _counters(F.col("pii_detections")), "workflow": F.lit("pattern_detection")}
    ).drop("_kept")


def exploded(df: DataFrame, *keys: str) -> DataFrame:
    """A row for each detection: the keys, det_ix and the span's fields."""
    return df.select(*keys, F.posexplode("pii_detections").alias("det_ix", "d")).select(*keys, "det_ix", "d.*")
