"""Spans of text: found by patterns, resolved, redacted, measured. Offsets are code points from 0, without the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rewrite import MARKS, headed, once, unmarked

SPAN = "struct<entity_type:string,start:int,end:int,score:double,text:string>"
SPANS = f"array<{SPAN}>"
BLOCK = 128


def none() -> Column:
    return F.array().cast(SPANS)


def found_in(text: Column, pattern: Column | str, clean: bool = False) -> Column:
    """array of struct(start, end, text) of a pattern's matches, from left to right; a match is never empty. `clean`: the text is unmarked() already."""
    a = MARKS[0]
    kind = "array<struct<start:int,end:int,text:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), F.array().cast(kind).alias("block"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        end = s["at"] + F.length(p)
        block, out = grown(s["block"], s["out"], F.struct(s["at"].alias("start"), end.alias("end"), p.alias("text")), kind)
        found = s["odd"] & (F.length(p) > 0)
        return F.struct(end.alias("at"), (~s["odd"]).alias("odd"), F.when(found, block).otherwise(s["block"]).alias("block"), F.when(found, out).otherwise(s["out"]).alias("out"))

    def read(marked: Column) -> Column:
        every = F.aggregate(F.split(marked, a, -1), zero, step, lambda s: F.flatten(F.concat(s["out"], F.array(s["block"]))))
        return F.when(F.contains(marked, F.lit(a)), every).when(marked.isNotNull(), F.array().cast(kind))

    own = text if clean else unmarked(text)
    return once(F.regexp_replace(own, pattern, F.lit(f"{a}$0{a}") if isinstance(pattern, Column) else f"{a}$0{a}"), read)


def positions(text: Column, pattern: Column | str) -> Column:
    """array of struct(start, end) of a pattern's matches, from left to right."""
    return F.transform(found_in(text, pattern), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))


def grown(block: Column, out: Column, item: Column, kind: str) -> tuple[Column, Column]:
    """A list in blocks of BLOCK, with one more item: the open block and those before it. An array is copied to grow, so one array would cost the square of its length."""
    full = F.size(block) >= BLOCK
    return F.when(full, F.array(item).cast(kind)).otherwise(F.concat(block, F.array(item))), F.when(full, F.concat(out, F.array(block))).otherwise(out)


def lowered(text: Column) -> Column:
    """A text as literal_positions() looks through it."""
    return F.lower(unmarked(text))


def literal_positions(text: Column, value: Column, low: Column | None = None) -> Column:
    """Where a value occurs whatever the case, overlapping places too. `low` is lowered(text), where many values are looked for."""
    return once(F.struct((lowered(text) if low is None else low).alias("low"), F.lower(value).alias("want")), lambda s: _literal(s["low"], s["want"]))


def _literal(low: Column, want: Column) -> Column:
    from .rewrite import escaped

    a = MARKS[0]
    n = F.length(want)
    # Places can only overlap if the value begins as it ends; all others are found without a pattern made for the row.
    again = F.contains(F.substring(want, F.lit(2), n), F.left(want, F.lit(1)))
    folds = again & F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: (k < n) & (F.left(want, k) == F.right(want, k)))
    apart = F.split(F.replace(low, want, F.lit(a)), a, -1)
    meeting = F.split(F.regexp_replace(low, F.concat(F.lit("(?="), escaped(want), F.lit(")")), F.lit(a)), a, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def places(parts: Column, skip: Column) -> Column:
        def step(s: Column, p: Column) -> Column:
            at = s["at"] + F.length(p)
            return F.struct((at + skip).alias("at"), F.concat(s["out"], F.array(F.struct(at.alias("start"), (at + n).alias("end")))).alias("out"))

        return once(parts, lambda x: F.aggregate(F.slice(x, F.lit(1), F.size(x) - 1), zero, step, lambda s: s["out"]))

    every = F.when(folds, places(meeting, F.lit(0))).otherwise(places(apart, n))
    return F.when(F.contains(low, want) & (n > 0), every).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def word_positions(text: Column, value: Column, low: Column | None = None) -> Column:
    """Where a value occurs as whole words, whatever the case, and neither joined to letters, digits, dots, hyphens or underscores before it nor part of a mail address."""

    def alone(p: Column) -> Column:
        # The characters on both sides of either end, with a blank where there is none.
        left = F.concat(F.when(p["start"] > 0, F.substring(text, p["start"], F.lit(1))).otherwise(" "), F.substring(text, p["start"] + 1, F.lit(1)))
        right = F.concat(F.substring(text, p["end"], F.lit(1)), F.when(p["end"] < F.length(text), F.substring(text, p["end"] + 1, F.lit(1))).otherwise(" "))
        edge = r"(?Us)^(?:\w\W|\W\w)$"
        return left.rlike(edge) & ~left.rlike("^[a-zA-Z0-9._-]") & right.rlike(edge) & ~F.substring(text, p["end"] + 1, F.length(text)).rlike("^[a-zA-Z0-9._-]*@")

    return F.filter(literal_positions(text, value, low), alone)


def find_spans(text: Column, pattern: str, entity: str, score: float, first: str = "", clean: bool = False) -> Column:
    """The spans of a pattern's matches; a match's text is taken where it is found, as counting to it from the start of the text costs that much for each."""

    def span(p: Column) -> Column:
        return F.struct(F.lit(entity).alias("entity_type"), p["start"].alias("start"), p["end"].alias("end"), F.lit(float(score)).alias("score"), p["text"].alias("text"))

    return F.coalesce(F.transform(found_in(text, headed(pattern, first), clean), span), none())


def clusters(spans: Column) -> Column:
    """Spans in order of the text, in arrays of those that overlap, so that no step compares all with all."""
    placed = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s.alias("s"))))
    kind = f"array<{SPANS}>"
    zero = F.struct(none().alias("own"), F.lit(0).alias("upto"), F.array().cast(kind).alias("block"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(c: Column, x: Column) -> Column:
        joins = F.struct(F.concat(c["own"], F.array(x["s"])).alias("own"), F.greatest(c["upto"], x["b"]).alias("upto"), c["block"].alias("block"), c["out"].alias("out"))
        block, out = grown(c["block"], c["out"], c["own"], kind)
        opens = F.struct(F.array(x["s"]).alias("own"), x["b"].alias("upto"), block.alias("block"), out.alias("out"))
        return F.when((F.size(c["own"]) == 0) | (x["a"] < c["upto"]), joins).otherwise(opens)

    return F.aggregate(placed, zero, step, lambda c: F.flatten(F.concat(c["out"], F.array(F.concat(c["block"], F.array(c["own"]))))))


def _each(spans: Column, f) -> Column:
    """f of every cluster of two and more, in order of the text."""
    return F.when(F.size(spans) < 2, spans).otherwise(F.flatten(F.transform(clusters(spans), lambda c: F.when(F.size(c) < 2, c).otherwise(f(c)))))


def within_type(spans: Column) -> Column:
    """Spans of one type in order of the text, once each, without those inside another of a score as high or higher."""

    def outer(own: Column) -> Column:
        return F.filter(own, lambda s: ~F.exists(own, lambda o: (o != s) & (o["start"] <= s["start"]) & (o["end"] >= s["end"]) & (o["score"] >= s["score"])))

    return once(spans, lambda every: _each(every, lambda c: once(F.array_distinct(c), outer)))


def resolve(spans: Column) -> Column:
    """Spans that do not overlap, in order of the text: the higher score wins, then the longer, the earlier, the type's name."""

    def step(kept: Column, x: Column) -> Column:
        s = x["s"]
        return F.when(F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), kept).otherwise(F.concat(kept, F.array(s)))

    def best(own: Column) -> Column:
        ranked = F.sort_array(F.transform(own, lambda s: F.struct((-s["score"]).alias("a"), (s["start"] - s["end"]).alias("b"), s["start"].alias("c"), s["entity_type"].alias("d"), s.alias("s"))))
        chosen = F.aggregate(ranked, none(), step)
        return F.transform(F.sort_array(F.transform(chosen, lambda s: F.struct(s["start"].alias("a"), s.alias("s")))), lambda x: x["s"])

    return once(spans, lambda every: _each(every, best))


def redact(text: Column, resolved: Column) -> Column:
    """text with each span as <TYPE>; spans are in order and do not overlap."""

    def pieces(part, length: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(resolved, i - 1)["end"])
            return F.concat(part(before, s["start"] - before), F.lit("<"), s["entity_type"], F.lit(">"))

        last = F.get(resolved, F.size(resolved) - 1)["end"]
        return F.concat(F.array_join(F.transform(resolved, piece), ""), part(last, length - last))

    few = pieces(lambda at, n: F.substring(text, at + 1, n), F.length(text))
    # Of many spans, through four bytes for each character, where no part has to be counted to.
    many = once(F.encode(text, "UTF-32"), lambda u: pieces(lambda at, n: F.decode(F.call_function("substring", u, at * 4 + 1, n * 4), "UTF-32"), F.shiftright(F.octet_length(u), 2)))
    return F.when(F.size(resolved) == 0, text).when(F.size(resolved) < 16, few).otherwise(many)


def characters(spans: Column) -> Column:
    """The distinct character positions of spans; an empty span has none."""
    return F.array_distinct(F.flatten(F.transform(F.filter(spans, lambda s: s["start"] < s["end"]), lambda s: F.sequence(s["start"], s["end"] - 1))))


def coverage(truth: Column, found: Column) -> Column:
    """The share of the truth's characters that are found; 0 without any."""
    return once(characters(truth), lambda own: F.when(F.size(own) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(own, characters(found))) / F.size(own)))
