"""Operator 2: secrets in texts, by DataFrame functions only.

Three base kinds are patterns.  A fourth, entropy, slides a window over candidate strings
and keeps sum(c * log2 c) over the window's character counts, changed by the two counts
that a step touches; fixed-point integers, so the sum never drifts.  A candidate is of the
class hex or mixed, and a run of letters and digits in any other candidate hex, lower, upper
or letters, each with a threshold of its own; known harmless forms are left out.  What a base
span or an earlier entropy span covers is cut from an entropy span, and the rest is kept.

Positions are code points.  They come from the lengths of what a pattern's matches leave
over, by two levels of sums, so a text with very many matches stays cheap.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, group whose length counts, least length.  The runs of the last two have their least length in the pattern: what is shorter can't hold a match.
BASE = (("assign", ASSIGN, 2, 8), ("access", "AKIA[A-Z0-9]{12,}", 0, 16), ("hex", "[0-9a-f]{32,}", 0, 32))
KINDS = ("assign", "access", "hex", "entropy")
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits a character from which a window of a class counts.
HEX_BITS, MIXED_BITS = 3.0, 3.7
#: A run between other characters: lower case and digits, letters of both cases, or upper case and digits, which +, /, _ and - may not join to others.
RUN = "(?<![A-Za-z0-9])(?:[a-z0-9]{20,}|[A-Za-z]{20,}|(?<![+/_-])[A-Z0-9]{20,}(?![+/_-]))(?![A-Za-z0-9])"
#: About one in a hundred random windows of 36, 32 and 52 letters and digits has less.
LOWER_BITS, UPPER_BITS, LETTERS_BITS = 3.4, 3.3, 3.55
#: Candidates that are no secrets: identifiers, dates, placeholders, runs of one alphabet, paths and joined words.
ALLOWED = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    r"|example|sample|dummy|placeholder|changeme|xxxx|0123456789|abcdefgh|^[-_=+/]+$"
    r"|^[a-z]+([-_/][a-z]+)*[0-9]{0,4}$|^[0-9_/=+-]+$"
)
#: Letters of both cases that are no secrets: placeholders here, and, as words joined by their capitals, what has at most a quarter of capitals.
PLACEHOLDER = "(?i)example|sample|dummy|placeholder|changeme|xxxx|abcdefgh"
UNIT, BLOCK = 1_000_000, 128
SPAN = "array<struct<start:int,kind:int,end:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, b: a + b)


def _upto(n: Column) -> Column:
    """0 .. n - 1, none for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str, group: int) -> Column:
    """array<struct<start, text, value>> of a pattern's matches, leftmost and apart."""
    raw = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"))

    def place(s: Column) -> Column:
        n = F.size(s["m"])
        step = F.transform(s["m"], lambda m, i: F.char_length(m) + F.char_length(s["p"][i]))

        def sums(x: Column) -> Column:
            blocks = F.transform(_upto(F.ceil(n / BLOCK).cast("int")), lambda b: _sum(F.slice(x, b * BLOCK + 1, F.lit(BLOCK))))
            before = let(blocks, lambda y: F.transform(y, lambda _, b: _sum(F.slice(y, F.lit(1), b))))
            block = lambda i: F.floor(i / BLOCK).cast("int")
            return let(before, lambda o: F.transform(_upto(n), lambda i: F.struct((o[block(i)] + _sum(F.slice(x, block(i) * BLOCK + 1, i % BLOCK)) + F.char_length(s["p"][i])).cast("int").alias("start"), s["m"][i].alias("text"), s["v"][i].alias("value"))))

        return let(step, sums)

    none = F.array().cast("array<struct<start:int,text:string,value:string>>")
    return F.when(F.rlike(text, F.lit(pattern)), let(raw, place)).otherwise(none)


def base_spans(text: Column) -> Column:
    out = []
    for k, (_, pattern, group, least) in enumerate(BASE):
        kept = F.filter(matches(text, pattern, group), lambda m: F.char_length(m["value"]) >= least)  # noqa: B023
        out.append(F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), (m["start"] + F.char_length(m["text"])).cast("int").alias("end"))))  # noqa: B023
    return F.array_sort(F.concat(*out))


def _g(count: Column) -> Column:
    """count * log2(count), in units."""
    table = F.lit([0] + [round(c * math.log2(c) * UNIT) for c in range(1, WINDOW + 1)])
    return F.element_at(table, count + 1)


def hot_windows(text: Column, most: Column) -> Column:
    """struct<first, last>: first and last window of a string with at most `most` units; -1 without any.

    The state of a step is the window's sum, changed only by the leaving and the coming character.
    """
    count = lambda x, c: F.size(F.filter(x, lambda y: y == c))

    def slide(chars: Column) -> Column:
        whole = F.slice(chars, 1, WINDOW)
        first = F.aggregate(F.array_distinct(whole), F.lit(0), lambda a, c: a + _g(count(whole, c)))

        def step(state: Column, k: Column) -> Column:
            def changed(x: Column) -> Column:  # the characters that stay, how many equal the leaving and the coming one
                gone, come = count(x, chars[k - 1]), count(x, chars[k + WINDOW - 1])
                return let(F.struct(gone.alias("g"), come.alias("c")), lambda n: state["s"] - _g(n["g"] + 1) + _g(n["g"]) - _g(n["c"]) + _g(n["c"] + 1))

            return let(
                let(F.slice(chars, k + 1, WINDOW - 1), changed),
                lambda s: F.struct(s.alias("s"), F.when((state["first"] < 0) & (s <= most), k).otherwise(state["first"]).alias("first"), F.when(s <= most, k).otherwise(state["last"]).alias("last")),
            )

        steps = F.when(F.size(chars) > WINDOW, F.sequence(F.lit(1), F.size(chars) - WINDOW)).otherwise(F.array().cast("array<int>"))
        start = let(first, lambda s: F.struct(s.alias("s"), F.when(s <= most, 0).otherwise(-1).alias("first"), F.when(s <= most, 0).otherwise(-1).alias("last")))
        return F.aggregate(steps, start, step)

    return let(F.split(text, ""), slide)


def _left(spans: Column, cover: Column) -> Column:
    """What is left of spans without what cover, sorted by start, has of them."""
    part = lambda start, end: F.array(F.struct(start.cast("int").alias("start"), F.lit(3).alias("kind"), end.cast("int").alias("end")))

    def rest(h: Column) -> Column:
        touching = F.filter(cover, lambda b: (b["start"] < h["end"]) & (h["start"] < b["end"]))
        state = F.struct(h["start"].alias("at"), F.array().cast(SPAN).alias("parts"))
        cut = lambda a, b: F.struct(F.greatest(a["at"], b["end"]).alias("at"), F.when(a["at"] < b["start"], F.concat(a["parts"], part(a["at"], b["start"]))).otherwise(a["parts"]).alias("parts"))
        return F.aggregate(touching, state, cut, lambda a: F.when(a["at"] < h["end"], F.concat(a["parts"], part(a["at"], h["end"]))).otherwise(a["parts"]))

    return F.flatten(F.transform(spans, rest))


def hot_spans(text: Column) -> Column:
    """Candidates (kind 3) and runs (kind 4) with a hot window, from the first such window to the end of the last."""
    units = lambda bits: round(WINDOW * (math.log2(WINDOW) - bits) * UNIT)
    has = lambda t, pattern: F.rlike(t, F.lit(pattern))
    is_hex = lambda t: has(t, "^([0-9a-f]+|[0-9A-F]+)$")
    mixed = lambda t: has(t, "[0-9]") & has(t, "[a-z]") & has(t, "[A-Z]")
    few = lambda t: 4 * F.char_length(F.regexp_replace(t, "[^A-Z]", "")) <= F.char_length(t)
    letters = lambda t: has(t, "[a-z]") & has(t, "[A-Z]") & ~has(t, PLACEHOLDER) & ~few(t)
    whole = F.filter(matches(text, CANDIDATE, 0), lambda m: ~has(m["text"], ALLOWED) & (is_hex(m["text"]) | mixed(m["text"])))
    runs = F.filter(matches(text, RUN, 0), lambda m: F.when(has(m["text"], "[0-9]"), ~has(m["text"], ALLOWED)).otherwise(letters(m["text"])))
    of = lambda ms, kind: F.transform(ms, lambda m: F.struct(m["start"].alias("start"), m["text"].alias("text"), F.lit(kind).alias("kind")))
    most = lambda t: (
        F.when(is_hex(t), units(HEX_BITS)).when(mixed(t), units(MIXED_BITS)).when(~has(t, "[0-9]"), units(LETTERS_BITS)).when(has(t, "[a-z]"), units(LOWER_BITS)).otherwise(units(UPPER_BITS))
    )
    span = lambda m, h: F.struct((m["start"] + h["first"]).cast("int").alias("start"), m["kind"].alias("kind"), F.when(h["first"] >= 0, m["start"] + h["last"] + WINDOW).otherwise(-1).cast("int").alias("end"))
    hot = F.transform(F.concat(of(whole, 3), of(runs, 4)), lambda m: let(hot_windows(m["text"], most(m["text"])), lambda h: span(m, h)))
    return F.filter(hot, lambda h: h["end"] >= 0)


def _told(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def found(rows: DataFrame) -> DataFrame:
    """rows of (text, row) with the columns base and spans of a text that isn't null.  In steps, as one expression is too deep for the analyzer."""
    d = rows.select("row", "text", base_spans(F.col("text")).alias("base"), hot_spans(F.col("text")).alias("hot"))
    of = lambda kind: F.filter("hot", lambda h: h["kind"] == kind)
    d = d.withColumn("base", F.concat("base", _left(of(3), F.col("base"))))
    d = d.withColumn("spans", F.array_sort(F.concat("base", _left(of(4), F.array_sort("base")))))
    return d.select("row", F.filter("base", lambda b: b["kind"] < 3).alias("base"), "spans")


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, text, base and spans (arrays of start, kind, end by start and kind; kind is a place in KINDS).

    A null text is searched as an empty one and stays null.  Rows are independent: null ids
    and repeated rows change nothing, an empty table gives an empty one, other columns are
    not read.
    """
    bounded(docs.sparkSession)
    d = docs.select(F.struct("doc_id", "text").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    return found(d).select("row.doc_id", "row.text", "base", "spans")


def redacted(docs: DataFrame) -> DataFrame:
    """All rows and columns, with each span of text replaced; n_chars, where there is one, follows."""
    bounded(docs.sparkSession)
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))  # a struct, so no name can clash
    d = found(d)
    text = F.col("row").getField("text")
    d = d.select("row", "spans", F.when(text.isNotNull(), redact(text, F.col("spans"))).alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("spans") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row").getField("n_chars"))
    return d.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """The digest columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    f = find_secrets(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return f.select("doc_id", *(count(k).alias(f"n_{kind}") for k, (kind, *_) in enumerate(BASE)), F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span, joined where they overlap, replaced by [SECRET]."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    cut = F.aggregate(
        spans,
        empty,
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.when(s["start"] < a["at"], a["parts"]).otherwise(F.concat(a["parts"], F.array(F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit("[SECRET]")))).alias("parts"),
            )
        ),
        lambda a: F.concat(F.array_join(a["parts"], ""), F.substr(text, a["at"] + 1)),
    )
    return F.when(F.size(spans) > 0, cut).otherwise(text)
