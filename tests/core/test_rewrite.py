import pytest
from pyspark.sql import functions as F

from veilframe.functions import rewrite as R


def one(spark, change, text, **more):
    return spark.createDataFrame([(text, *more.values())], ", ".join(f"{c} string" for c in ("t", *more))).select(change(F.col("t"))).first()[0]


CASES = [
    (R.normalize_number_words, "zero four one two three four five six seven", "041234567"),
    (R.normalize_number_words, "Call me at zero four one two and ask for extension five six seven", "Call me at 0412 and ask for extension 567"),
    (R.normalize_number_words, "Zero ONE two, twenty one; nothing, everything", "012, 201; nothing, everything"),
    (R.normalize_number_words, "   ", "   "),
    (R.normalize_separated_chars, "My surname is s m i t h, and my ID is a 1 b 2", "My surname is smith, and my ID is a1b2"),
    (R.normalize_separated_chars, "I have a grade of A in mathematics.", "I have a grade of A in mathematics."),
    (R.normalize_email_addresses, "john michael smith at gmail dot com", "john michael.smith@gmail.com"),
    (lambda t: R.normalize_email_addresses(t, 1), "john smith at gmail dot com", "john smith@gmail.com"),
    (lambda t: R.normalize_email_addresses(t, 3), "a b c at Acme Corp dot Org now", "a.b.c@acmecorp.org now"),
    (R.normalize_email_addresses, "meet me at noon", "meet me at noon"),
    (R.remove_filler_words, "I uh need to mm mm check my hmm account", "I need to check my account"),
    (lambda t: R.remove_filler_words(t, keep_placeholder=True), "I um know", "I <FILLER> know"),
    (lambda t: R.remove_filler_words(t, "$1"), "I um know", "I $1 know"),
    (R.normalize_text, "my number is zero four uh one", "my number is 04 1"),
    (R.sweep_months, "Events in january, FEBRUARY, and March; may stays", "Events in <MONTH>, <MONTH>, and <MONTH>; may stays"),
    (R.sweep_ordinals, "The first prize, 2nd place, twenty first and thirty-first, 32nd", "The first prize, <GENERIC_NUMBER> place, <GENERIC_NUMBER> and <GENERIC_NUMBER>, 32nd"),
    (lambda t: R.sweep_custom(t, {"<P>": ["John Smith", "John"], "<L>": [], "<S>": ["a.b"]}), "john smith, John, axb a.b", "<P>, <P>, axb <S>"),
    (lambda t: R.sweep_text(t, custom={}), "Jan 1st", "<MONTH> <GENERIC_NUMBER>"),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases(spark, i):
    change, text, want = CASES[i]
    assert one(spark, change, text) == want


@pytest.mark.parametrize("change", [R.normalize_text, R.sweep_text, R.normalize_email_addresses, R.normalize_number_words])
def test_null_and_empty(spark, change):
    assert one(spark, change, None) is None
    assert one(spark, change, "") == ""


def test_fields(spark):
    def change(t):
        return R.sweep_fields(t, {"<P>": [F.col("a"), F.col("b")], "<M>": [F.col("c")]})

    assert one(spark, change, "Odette $5 met odette. (x)", a=" Odette ", b=None, c="") == "<P> $5 met <P>. (x)"
    assert one(spark, change, "nothing", a=None, b=" ", c=None) == "nothing"
