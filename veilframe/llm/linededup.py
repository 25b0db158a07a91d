"""Line deduplication by an edit-distance join on segments.

Built-in expressions only. A line is cut into threshold plus one segments; a line within the
threshold holds one of them unchanged, at a place that the two lengths bound. So every line gives the
hashes of its own segments, and of those substrings that can be a segment of a line as long or
shorter. What is grouped first is hashes alone, with partial sums; only those that two different
lines have go on, with their lines. These meet in groups of bounded size, cut into blocks of which
any two meet where a hash is frequent, and are verified by a bit-parallel edit distance over the
diagonal band. Of each group only a spanning forest of the links leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import connected_components, fits, fresh, release, written

#: Hashes that two lines have are broadcast up to so many (16 MB).
BROADCAST_KEYS = 1_000_000


def lines_of(text: Column) -> Column:
    """The lines of a text; a null text has none."""
    return F.coalesce(F.split(text, "\n", -1), F.array().cast("array<string>"))


def key_of(line: Column) -> Column:
    """What lines are compared by: without white space at the ends. Blank lines are not compared."""
    return F.btrim(line, F.lit(" \t\r\x0b\x0c"))


def wide(line: Column) -> Column:
    """Four bytes for each character, so that a substring needs no scan."""
    return F.encode(line, "UTF-32")


def places(threshold: int) -> list[tuple[int, int, int]]:
    """(d, i, shift) of the substrings that can be segment i of a line shorter by d; (0, i, 0) are the line's own segments.

    With i segments before it and d the difference of the lengths, a segment lies at most so far from
    its place that the edits to its left and to its right add up to the threshold: as seen from the
    left i of them at most, as seen from the right threshold - i.
    """
    out = []
    for d in range(threshold + 1):
        for i in range(threshold + 1):
            low, high = max(-i, d - (threshold - i)), min(i, d + (threshold - i))
            out += [(d, i, shift) for shift in range(low, high + 1)]
    return out


def entries(lines: DataFrame, threshold: int, *keep: str) -> DataFrame:
    """h and own for each substring of a line at places(), with the kept columns; lines have u, as wide() gives it, and n characters.

    h is a hash of the shorter line's length, the segment's number, and the segment; own is 1 for the
    line's own segments. A line no longer than the threshold has empty segments, and so meets all
    lines that are close in length.
    """
    k = threshold + 1
    each = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(s).alias("s")) for d, i, s in places(threshold)])
    e = lines.select(*keep, "u", "n", F.explode(each).alias("p"))
    e = e.select(*keep, "u", "n", F.col("p.i").alias("i"), F.col("p.s").alias("s"), F.col("p.d").alias("d"), (F.col("n") - F.col("p.d")).alias("o"))
    # The last o % k segments are longer by one.
    e = e.withColumn("base", F.expr(f"cast(o div {k} as int)")).withColumn("more", F.expr(f"o % {k}"))
    e = e.withColumn("at", F.expr(f"i * base + greatest(0, i - {k} + more) + s")).withColumn("z", F.expr(f"base + if(i >= {k} - more, 1, 0)"))
    e = e.where("o > 0 and at >= 0 and at + z <= n")
    return e.select(*keep, F.xxhash64("o", "i", F.expr("substring(u, 4 * at + 1, 4 * z)")).alias("h"), F.expr("cast(d = 0 and s = 0 as int)").alias("own"))


def _once(f, **values: Column) -> Column:
    """f of a struct of the values, each computed once however often f uses it."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), f)[0]


def chars_in(u: Column) -> Column:
    return F.shiftright(F.octet_length(u), 2)


def _part(u: Column, start: Column, chars: Column) -> Column:
    return F.call_function("substring", u, start * 4 + 1, chars * 4)


def _same_ends(a: Column, b: Column, size: Column, back: bool) -> Column:
    """How many characters a and b, both wide(), have in common at their beginnings (or ends), `size` at most; found by halving steps."""
    na, nb = chars_in(a), chars_in(b)

    def step(n: Column, x: Column) -> Column:
        at = (na - n - x, nb - n - x) if back else (n, n)
        return F.when((n + x <= size) & (_part(a, at[0], x) == _part(b, at[1], x)), n + x).otherwise(n)

    steps = F.filter(F.array(*[F.lit(1 << e) for e in range(28, -1, -1)]), lambda x: x <= size)
    return F.aggregate(steps, F.lit(0), step)


def distance(a: Column, b: Column, threshold: int) -> Column:
    """The edit distance of a and b, which is as long or longer, both wide(); threshold + 1 stands for all that is more.

    What the lines have in common at their ends is left out. Over the rest goes one step for each
    character of b, with a word of 2 * threshold + 1 bits, of which bit r stands for row
    j - threshold + r of column j. The distance is followed along the diagonal that ends in the last
    cell, on which it never falls, so that the rest is skipped once it is too large.
    """
    k, width = threshold, 2 * threshold + 1
    full = (1 << width) - 1

    def low(x: int) -> Column:
        return F.lit(x).cast("int")

    def step(s: Column, acc: Column, j: Column) -> Column:
        c = _part(s["b"], s["p"] + j - 1, low(1))
        match = low(0)
        for r in range(width):
            row = j - (k - r)
            match = match + F.when((row >= 1) & (row <= s["size"]) & (_part(s["a"], s["p"] + row - 1, low(1)) == c), low(1 << r)).otherwise(low(0))
        first = F.struct(
            match.alias("pm"),
            F.shiftright(acc["vp"], 1).bitwiseOR(low(1 << 2 * k)).alias("vp"),
            F.shiftright(acc["vn"], 1).alias("vn"),
            acc["d"].alias("d"),
        )

        def second(x: Column) -> Column:
            d0 = (x["pm"].bitwiseAND(x["vp"]) + x["vp"]).bitwiseXOR(x["vp"]).bitwiseOR(x["pm"]).bitwiseOR(x["vn"]).bitwiseAND(low(full))
            return F.struct(d0.alias("d0"), x["vp"].alias("vp"), x["vn"].alias("vn"), x["d"].alias("d"))

        def third(x: Column) -> Column:
            hp = F.shiftleft(x["vn"].bitwiseOR(F.bitwise_not(x["d0"].bitwiseOR(x["vp"]))), 1).bitwiseOR(low(1))
            hn = F.shiftleft(x["d0"].bitwiseAND(x["vp"]), 1)
            on = F.call_function("shiftright", x["d0"], k - s["gap"]).bitwiseAND(low(1))
            return F.struct(
                hn.bitwiseOR(F.bitwise_not(x["d0"].bitwiseOR(hp))).bitwiseAND(low(full)).alias("vp"),
                hp.bitwiseAND(x["d0"]).bitwiseAND(low(full)).alias("vn"),
                (x["d"] + F.when(j > s["gap"], low(1) - on).otherwise(low(0))).alias("d"),
            )

        return F.transform(F.transform(F.array(first), second), third)[0]

    def banded(s: Column) -> Column:
        start = F.struct(low(full & ~((1 << (k + 1)) - 1)).alias("vp"), low((1 << (k + 1)) - 1).alias("vn"), s["gap"].alias("d"))
        longer = s["size"] + s["gap"]

        def stretch(acc: Column, at: Column) -> Column:
            more = F.aggregate(F.sequence(at, F.least(at + 15, longer)), acc, lambda x, j: step(s, x, j))
            return F.when(acc["d"] > k, acc).otherwise(more)

        found = F.aggregate(F.sequence(low(1), longer, low(16)), start, stretch, lambda x: F.least(x["d"], F.lit(k + 1)))
        return F.when(s["size"] == 0, s["gap"]).otherwise(found)

    def without_end(s: Column) -> Column:
        q = _same_ends(s["a"], s["b"], chars_in(s["a"]) - s["p"], True)
        return _once(banded, a=s["a"], b=s["b"], p=s["p"], size=chars_in(s["a"]) - s["p"] - q, gap=s["gap"])

    def without_start(s: Column) -> Column:
        p = _same_ends(s["a"], s["b"], chars_in(s["a"]), False)
        return F.when(s["gap"] > k, F.lit(k + 1)).otherwise(_once(without_end, a=s["a"], b=s["b"], p=p, gap=s["gap"]))

    return _once(without_start, a=a, b=b, gap=chars_in(b) - chars_in(a))


def sketch(u: Column) -> Column:
    """64 bits of a line as wide() gives it: of each the parity of the places whose two characters (at the end, one) hash to it.

    An edit takes away two such places and adds two, at most. So it changes four bits at most, and
    lines whose sketches differ in more than four bits for each edit need no comparison.
    """

    def flip(acc: Column, at: Column) -> Column:
        return acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.hash(_part(u, at, F.lit(2)))))

    return F.aggregate(F.sequence(F.lit(0), chars_in(u) - 1), F.lit(0).cast("long"), flip)


def forest(group: Column, threshold: int, per_edit: int) -> Column:
    """The edges (u, v) of a spanning forest of the links in a group, an array of (id, own, n, line as wide() gives it, sketch()).

    Of a pair one has to be there with a segment of its own. Lines that are joined already are not
    compared again, nor are those whose sketches are too far apart.
    """

    def near(x: Column, y: Column) -> Column:
        most = F.least(F.lit(threshold), F.floor(F.greatest(x["n"], y["n"]) / per_edit).cast("int"))
        swap = x["n"] > y["n"]
        d = distance(F.when(swap, y["u"]).otherwise(x["u"]), F.when(swap, x["u"]).otherwise(y["u"]), threshold)
        apart = F.bit_count(x["sketch"].bitwiseXOR(y["sketch"]))
        return ((x["own"] + y["own"]) > 0) & (F.abs(x["n"] - y["n"]) <= most) & (apart <= most * 4) & (d <= most)

    def column(s: Column, j: Column) -> Column:
        def cell(s: Column, i: Column) -> Column:
            own, other = F.get(s["of"], j), F.get(s["of"], i)
            x, y = F.get(group, i), F.get(group, j)
            joined = F.struct(F.transform(s["of"], lambda c: F.when(c == other, own).otherwise(c)).alias("of"), F.concat(s["e"], F.array(F.struct(x["id"].alias("u"), y["id"].alias("v")))).alias("e"))
            return F.when((own != other) & near(x, y), joined).otherwise(s)

        return F.aggregate(F.sequence(F.lit(0), j - 1), s, cell)

    start = F.struct(F.sequence(F.lit(0), F.size(group) - 1).alias("of"), F.array().cast("array<struct<u:struct<a:bigint,b:bigint>,v:struct<a:bigint,b:bigint>>>").alias("e"))
    return F.when(F.size(group) > 1, F.aggregate(F.sequence(F.lit(1), F.size(group) - 1), start, column, lambda s: s["e"]))


def name_of(key: Column) -> list[Column]:
    """Two hashes that stand for a line."""
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b")]


def links(keys: DataFrame, threshold: int = 2, per_edit: int = 8, block: int = 256) -> DataFrame:
    """Edges (u, v) that join all lines within the threshold, of a table of lines `key` with repeats; u and v are name_of().

    The edges are a forest of each group, not all pairs. Two lines are linked by as many edits as the
    longer one has `per_edit` characters, `threshold` at most. A hash with more than `block` lines (a
    line counts once more for each 1024 characters) is cut into blocks of half that on average.
    """
    lines = keys.select("key", wide(F.col("key")).alias("u")).withColumn("n", chars_in(F.col("u"))).where(F.col("n") + threshold >= per_edit)
    named = lines.select("key", "u", "n", F.xxhash64("key").alias("id"))
    by_hash = entries(named, threshold, "id").groupBy("h").agg(F.min("id").alias("x"), F.max("id").alias("y"), F.max("own").alias("own"))
    met = written(by_hash.where("x != y and own = 1").select("h"), "lines-met")
    if fits(met, BROADCAST_KEYS):
        found = entries(lines, threshold, "key").join(F.broadcast(met), "h")
    else:  # the hashes alone meet, then the lines that some hash is of
        some = written(entries(named, threshold, "id").join(met, "h").groupBy("h", "id").agg(F.max("own").alias("own")), "lines-some")
        texts = named.select("id", "key").join(some.select("id").distinct(), "id", "left_semi").distinct()
        found = some.join(texts, "id")
    members = written(found.groupBy("h", "key").agg(F.max("own").alias("own")), "lines-members")
    weight = F.sum(F.floor(F.length("key") / 1024) + 1)
    full = written(members.groupBy("h").agg(weight.alias("w")).where(F.col("w") > block).select("h", F.ceil(F.col("w") * 2 / block).cast("int").alias("blocks")), "lines-full")
    at = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: i != at)
    pairs = F.transform(others, lambda i: F.struct(F.least(i, at).alias("i"), F.greatest(i, at).alias("j")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    dealt = members.join(F.broadcast(full) if fits(full, 100_000) else full, "h", "left")
    dealt = dealt.select("h", "key", "own", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(pairs)).alias("at"))
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # else few bytes would mean few tasks
    groups = dealt.repartition(parts, "h", "at").groupBy("h", "at").agg(F.collect_list(F.struct("key", "own")).alias("g"))
    line = F.transform("g", lambda x: F.struct(F.struct(*name_of(x["key"])).alias("id"), x["own"].alias("own"), F.length(x["key"]).alias("n"), wide(x["key"]).alias("u")))
    few = F.size("g") < 4  # fewer comparisons than sketches
    line = F.transform(line, lambda x: F.struct(x["id"].alias("id"), x["own"].alias("own"), x["n"].alias("n"), x["u"].alias("u"), F.when(few, F.lit(0).cast("long")).otherwise(sketch(x["u"])).alias("sketch")))
    edges = groups.select(F.explode(_once(lambda s: forest(s["g"], threshold, per_edit), g=line)).alias("e"))
    return edges.select("e.u", "e.v").distinct()


def _occurrences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each line that is not blank: d (id), t (hash of the text), line (from 0), key."""
    rows = df.select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("t"), F.posexplode(lines_of(F.col(text_col))).alias("line", "own"))
    return rows.select("d", "t", "line", key_of(F.col("own")).alias("key")).where("key != ''")


def dropped_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, per_edit: int = 8, block: int = 256) -> DataFrame:
    """d (id), t (xxhash64 of the text), lines (numbers from 0, in order) of the documents that repeat lines.

    Lines of one class (equal, or linked by links()) are kept once: where they come first by id
    (nulls last), then text hash, then line.
    """
    seen = _occurrences(df, id_col, text_col)
    classes = connected_components(links(seen.select("key"), threshold, per_edit, block))
    classes = written(classes.select(F.col("node.a").alias("a"), F.col("node.b").alias("b"), F.col("component.a").alias("ca"), F.col("component.b").alias("cb")), "lines-classes")
    own = seen.select("d", "t", "line", *name_of(F.col("key"))).join(F.broadcast(classes) if fits(classes, BROADCAST_KEYS // 4) else classes, ["a", "b"], "left")
    own = written(own.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"), "d", "t", "line"), "lines-own")
    several = written(own.groupBy("a", "b").agg(F.count("*").alias("k")).where("k > 1").select("a", "b"), "lines-several")
    again = own.join(F.broadcast(several) if fits(several, BROADCAST_KEYS // 2) else several, ["a", "b"])
    again = again.select("a", "b", F.struct(F.col("d").isNull().alias("n"), "d", "t", "line").alias("at"))
    first = written(again.groupBy("a", "b").agg(F.min("at").alias("first")), "lines-first")
    more = again.join(F.broadcast(first) if fits(first, BROADCAST_KEYS // 4) else first, ["a", "b"]).where("at != first")
    gone = written(more.groupBy("at.d", "at.t").agg(F.array_sort(F.collect_set("at.line")).alias("lines")), "lines-gone")
    release(classes, own, several, first)
    return gone


def _with_dropped(df: DataFrame, gone: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """df with a column `name` of dropped line numbers; their table is broadcast where it is small."""
    d, t = fresh(df, "d", "t")
    size = gone.agg(F.count("*"), F.sum(F.size("lines"))).first()
    gone = gone.select(F.col("d").alias(d), F.col("t").alias(t), F.col("lines").alias(name))
    side = F.broadcast(gone) if 32 * size[0] + 4 * (size[1] or 0) <= 16 << 20 else gone
    return df.join(side, df[id_col].eqNullSafe(gone[d]) & (F.xxhash64(df[text_col]) == gone[t]), "left").drop(d, t)


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, per_edit: int = 8, block: int = 256) -> DataFrame:
    """One row per document: id, n_lines, n_dropped, dropped (line numbers from 0, as text), kept_chars (without line ends).

    A line is dropped if its class has come before: equal lines, and lines that a chain of links
    joins; a link is of one edit for each `per_edit` characters of the longer line, `threshold` at
    most. White space at the ends does not count; blank lines are kept. A null text has no lines, an
    empty one has one. Rows with the same id and text are one document and have the same result each;
    an empty table gives no rows; other columns are ignored.
    """
    gone = dropped_lines(df, id_col, text_col, threshold, per_edit, block)
    out = _with_dropped(df.select(F.col(id_col).alias("d"), F.col(text_col).alias("x")), gone, "d", "x", "lines")
    out = out.select("d", F.transform(lines_of(F.col("x")), lambda x: F.length(x)).alias("sizes"), "lines")
    gone_chars = F.coalesce(F.aggregate("lines", F.lit(0).cast("long"), lambda a, i: a + F.col("sizes")[i]), F.lit(0))
    return out.select(
        F.col("d").alias(id_col),
        F.size("sizes").cast("long").alias("n_lines"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join("lines", ","), F.lit("")).alias("dropped"),
        (F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x) - gone_chars).alias("kept_chars"),
    )


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, per_edit: int = 8, block: int = 256) -> DataFrame:
    """df with texts without their dropped lines, as report() tells; documents that lose all their lines that are not blank go.

    A document that had no such line before stays as it is. All columns of df stay, whatever their names.
    """
    lines, rest = fresh(df, "lines", "rest")
    out = _with_dropped(df, dropped_lines(df, id_col, text_col, threshold, per_edit, block), id_col, text_col, lines)
    left = F.filter(F.transform(lines_of(F.col(text_col)), lambda x, i: F.when(~F.array_contains(lines, i), x)), lambda x: x.isNotNull())
    out = out.withColumn(rest, F.when(F.col(lines).isNotNull(), left))
    out = out.where(F.col(rest).isNull() | F.exists(rest, lambda x: key_of(x) != ""))
    text = F.when(F.col(rest).isNotNull(), F.array_join(rest, "\n")).otherwise(F.col(text_col))
    return out.withColumn(text_col, text).select(*df.columns)
