"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

The fixed patterns give the base spans and the seed entities. The words around a seed are lexical
patterns; patterns and the values they surround form a bipartite graph. In each round a pattern is scored
by the share of known values among its values, and a value by the patterns that surround it. Values whose
score is high enough become known, and all their occurrences are spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upliftlens.llm.common import Scratch

#: In the order that breaks ties of spans.
KINDS = ("email", "ip", "card", "phone")

# Possessive forms of the fixed patterns: a run of local-part characters or digits either matches from its
# first character (or from the end of the last match) or not at all, so nothing is tried twice.
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has no valid span of the kind.
NEEDS = {
    "email": r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"(?:[0-9][\x20-]?){13}[0-9]",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: What looks like an identifier: groups of digits with single marks or spaces between them, perhaps in
#: brackets, or a token with a digit or an at sign inside; at least five characters long.
GROUPS = r"\(?[0-9]++\)?(?:[\x20.-]{1,2}\(?[0-9]++\)?)++(?![0-9A-Za-z@])"
SINGLE = r"[\"'(\[<]*+(?=[^\s\"'()\[\]<>,;]*[0-9@])[^\s\"'()\[\]<>,;]{5,}+"
TOKEN = rf"(?<!\S)(?:{GROUPS}|{SINGLE})"
#: Spans whose places are summed up at once, see `located`.
RUN = 256
#: Characters on either side of a span in which its context is looked for.
REACH = 80


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""

    def value(d: Column, i: Column) -> Column:
        doubled = d.cast("int") * (F.pmod(i, F.lit(2)) + 1)
        return doubled - F.when(doubled > 9, 9).otherwise(0)

    values = F.transform(F.split(F.reverse(digits), ""), value)
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def located(text: Column, pattern: str) -> Column:
    """All matches of a pattern: start and end in code points, value, and the text on both sides.

    What lies between the matches gives their places. Places are summed up in runs of matches, and the lengths
    of the runs by themselves, so a text with very many matches takes time in proportion.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(acc: Column, piece: Column) -> Column:
        start = acc["pos"] + F.length(piece["gap"])
        end = start + F.length(piece["value"])
        found = F.struct(
            start.alias("start"),
            end.alias("end"),
            piece["value"].alias("value"),
            F.right(piece["gap"], F.lit(REACH)).alias("before"),
            F.left(piece["next"], F.lit(REACH)).alias("after"),
        )
        return F.struct(end.alias("pos"), F.concat(acc["spans"], F.array(found)).alias("spans"))

    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")

    def run(pieces: Column, start: Column) -> Column:
        zero = F.struct(start.alias("pos"), none.alias("spans"))
        return F.aggregate(pieces, zero, step, lambda acc: acc["spans"])

    def places(pieces: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(pieces), F.lit(RUN))

        def length(first: Column) -> Column:
            own = F.slice(pieces, first, F.lit(RUN))
            return F.aggregate(own, F.lit(0), lambda n, p: n + F.length(p["gap"]) + F.length(p["value"]))

        def start(acc: Column, first: Column) -> Column:
            entry = F.struct(first.alias("first"), acc["pos"].alias("pos"))
            return F.struct((acc["pos"] + length(first)).alias("pos"), F.concat(acc["runs"], F.array(entry)).alias("runs"))

        zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<first:int,pos:int>>").alias("runs"))
        runs = F.aggregate(firsts, zero, start, lambda acc: acc["runs"])
        return F.flatten(F.transform(runs, lambda r: run(F.slice(pieces, r["first"], F.lit(RUN)), r["pos"])))

    def zipped(found: Column) -> Column:
        gaps, n = found["gaps"], F.size(found["matches"])
        both = F.zip_with(found["matches"], gaps, lambda m, g: F.struct(g.alias("gap"), m.alias("value")))
        return F.zip_with(
            F.slice(both, F.lit(1), n),
            F.slice(gaps, F.lit(2), n),
            lambda p, after: F.struct(p["gap"].alias("gap"), p["value"].alias("value"), after.alias("next")),
        )

    found = F.struct(matches.alias("matches"), F.split(text, pattern, -1).alias("gaps"))
    some = let(let(found, zipped), lambda pieces: F.when(F.size(pieces) > 0, places(pieces)).otherwise(none))
    return F.when(text.rlike(pattern), some).otherwise(none)


def base_spans(text: Column) -> Column:
    """The valid matches of all kinds by start, then kind."""
    empty = F.array().cast(
        "array<struct<start:int,rank:int,end:int,kind:string,value:string,before:string,after:string>>"
    )
    def of_kind(rank: int, kind: str) -> Column:
        def span(m: Column) -> Column:
            return F.struct(
                m["start"].alias("start"),
                F.lit(rank).alias("rank"),
                m["end"].alias("end"),
                F.lit(kind).alias("kind"),
                m["value"].alias("value"),
                m["before"].alias("before"),
                m["after"].alias("after"),
            )

        real = F.filter(located(text, PATTERNS[kind]), lambda m: valid(kind, m["value"]))
        return F.when(text.rlike(NEEDS[kind]), F.transform(real, span)).otherwise(empty)

    parts = [of_kind(rank, kind) for rank, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*parts))


def contexts(value: Column, before: Column, after: Column) -> Column:
    """The lexical patterns of an occurrence: the two words before it, and one word on a side with its shape."""
    shape = F.regexp_replace(F.regexp_replace(value, "[0-9]+", "9"), r"\p{L}+", "a")
    left = F.split(F.lower(F.trim(F.regexp_replace(before, r"[^\p{L}\p{N}:=#]+", " "))), " ")
    right = F.split(F.lower(F.trim(F.regexp_replace(after, r"[^\p{L}\p{N}:=#]+", " "))), " ")
    one, other = F.get(F.reverse(left), F.lit(0)), F.get(right, F.lit(0))
    all_of = F.array(
        F.when(F.size(left) > 1, F.concat(F.lit("2 "), F.get(F.reverse(left), F.lit(1)), F.lit(" "), one)),
        F.when(one != "", F.concat(F.lit("1 "), one, F.lit(" "), shape)),
        F.when(other != "", F.concat(F.lit("0 "), other, F.lit(" "), shape)),
    )
    return F.array_compact(all_of)


def discover(
    edges: DataFrame, scratch: Scratch, rounds: int | None, min_values: int, min_pattern: float, min_value: float
) -> DataFrame:
    """(pattern, value, kind or NULL) -> (value, kind, score) of values that patterns make known.

    Rounds go on until one adds no value, or until `rounds` are done.
    """
    seeds = edges.filter("kind is not null").select("value", "kind").distinct()
    known = scratch.save(seeds.withColumn("score", F.lit(1.0)), "known_0")
    links = scratch.save(edges.select("pattern", "value").distinct(), "links")
    totals = scratch.save(links.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "totals")
    r, before = 0, seeds.count()
    while rounds is None or r < rounds:
        r += 1
        patterns = (
            links.join(known, "value")
            .groupBy("pattern", "kind")
            .agg(F.sum("score").alias("hits"))
            .join(totals, "pattern")
            .withColumn("trust", F.col("hits") / F.col("n"))
            .filter((F.col("hits") >= min_values) & (F.col("trust") >= min_pattern))
            .select("pattern", "kind", "trust")
        )
        patterns = scratch.save(patterns, f"patterns_{r}")
        scored = (
            links.join(patterns, "pattern")
            .groupBy("value", "kind")
            .agg((1 - F.exp(F.sum(F.log(1 + 1e-6 - F.col("trust"))))).alias("score"))
            .filter(F.col("score") >= min_value)
        )
        fresh = scored.join(seeds.select("value"), "value", "left_anti")
        # a value that has become known stays, so rounds come to an end
        old = known.join(seeds.select("value"), "value", "left_anti").unionByName(fresh)
        old = old.groupBy("value", "kind").agg(F.max("score").alias("score"))
        known = scratch.save(seeds.withColumn("score", F.lit(1.0)).unionByName(old), f"known_{r}")
        after = known.count()
        if after == before:
            break
        before = after
    found = known.join(seeds.select("value"), "value", "left_anti")
    best = found.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("b"))
    return best.select("value", F.col("b.kind").alias("kind"), F.col("b.score").alias("score"))


def span_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(
    docs: DataFrame,
    scratch: Scratch | None = None,
    rounds: int | None = None,
    min_values: int = 3,
    min_pattern: float = 0.8,
    min_value: float = 0.8,
) -> DataFrame:
    """One row per row of `docs`: doc_id, base (spans), spans (base and discovered, by start, then kind).

    A span has start, rank, end, kind and value, in code points, its end exclusive. NULL and empty texts
    have none. Discovered spans never overlap base spans. `min_values` known values and a share of
    `min_pattern` make a pattern trusted; rounds end when none adds a value, or after `rounds`. Rows that repeat an id are searched each. Other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = F.when(
        text.rlike(TOKEN),
        F.transform(
            located(text, TOKEN),
            lambda t: F.struct(
                # opening brackets and full stops at the end are no part of the value
                (t["end"] - F.length(F.regexp_replace(t["value"], r"^[\"'(\[<]+", ""))).alias("start"),
                (t["end"] - F.length(F.regexp_extract(t["value"], r"[.:!?]*$", 0))).alias("end"),
                F.regexp_replace(t["value"], r"^[\"'(\[<]+|[.:!?]+$", "").alias("value"),
                t["before"].alias("before"),
                t["after"].alias("after"),
            ),
        ),
    )
    rows = scratch.save(
        docs.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", base_spans(text).alias("base"), tokens.alias("tokens")
        ),
        "rows",
    )

    def apart(t: Column) -> Column:
        return ~F.exists("base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"]))

    seen = rows.select("row", F.explode("base").alias("s")).select(
        "row", F.col("s.kind").alias("kind"), "s.start", "s.end", "s.value", "s.before", "s.after"
    )
    unseen = rows.select("row", F.explode(F.filter("tokens", apart)).alias("s")).select(
        "row", F.lit(None).cast("string").alias("kind"), "s.start", "s.end", "s.value", "s.before", "s.after"
    )
    unseen = scratch.save(unseen.filter(F.length("value") >= 5), "unseen")
    edges = (
        seen.unionByName(unseen)
        .select(
            F.explode(contexts(F.col("value"), F.col("before"), F.col("after"))).alias("pattern"), "value", "kind"
        )
        .distinct()
    )
    found = discover(edges, scratch, rounds, min_values, min_pattern, min_value)
    added = (
        unseen.select("row", "start", "end", "value")
        .join(found, "value")
        .select(
            "row",
            F.struct(
                "start",
                F.expr(f"array_position(array{KINDS}, kind)").cast("int").alias("rank"),
                "end",
                "kind",
                "value",
            ).alias("s"),
        )
        .withColumn("s", F.col("s").withField("rank", F.col("s.rank") - 1))
        .groupBy("row")
        .agg(F.collect_list("s").alias("added"))
    )
    added = scratch.save(added, "added")
    plain = F.transform("base", lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "kind", "value")]))
    base = rows.select("row", "doc_id", plain.alias("base"))
    return base.join(added, "row", "left").select(
        "doc_id", "base", F.array_sort(F.concat("base", F.coalesce("added", F.slice("base", 1, 0)))).alias("spans")
    )
