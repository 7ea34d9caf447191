"""Near-equal lines by an exact set-similarity join on their words.

A line is the set of its words. Words are ordered by rarity, so two similar sets share one of their first
few words (prefix filter). Pairs that meet on a word are thinned by length, by position in the prefix and
by a 128-bit parity sketch whose difference can't exceed the difference of the sets; what is left is
verified on the words themselves. Equal sets are one class from the start.

A line goes if an earlier line is similar, by (doc_id, position). So a class needs just one earlier
partner: each class is first tried against the earliest class with the same min-hashes of its rarer words, which
settles the members of large groups of near copies, and only pairs with an unsettled class enter the join. Of the
pairs that it finds, a class tries the earlier one with the least difference of sketches first, so the pairs whose
words are compared grow as the classes and not as the square of a group.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upliftlens.llm.common import SPACE, SPACE_CHARS, Scratch, fixed_array, hashed_members, one_bit

#: Words are counted in this many hash buckets for the rarity order. Any total order gives the same
#: pairs; a coarser one only makes more candidates.
RARITY_BUCKETS = 262144
HASH_BITS = 48
MASK = (1 << HASH_BITS) - 1
#: Words of prefixes as they are joined: fewer bits only make more candidates.
PREFIX_MASK = (1 << 31) - 1
#: Prefixes are joined in so many parts by word.
JOIN_PARTS = 2
#: A bit of a word's hash that tells in which half of the sketch it counts. Sets of up to SHORT words use the first half only.
HALF = 1 << 26
SHORT = 64
#: Orders of the word hashes, whose minima are min-hashes; two of them together are a key of a class.
ORDERS = (0x5DEECE66D3A1, 0x2545F4914F6C, 0x9E3779B97F4A, 0xC2B2AE3D27D4, 0x165667B19E37, 0x27D4EB2F1656)
PAIRS = ((0, 1), (2, 3), (4, 5))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, th, line, body): the lines of each text; th tells texts under one id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", F.xxhash64(text).alias("th"), F.split(text, "\n").alias("parts"))
    return split.select("doc_id", "th", F.posexplode("parts").alias("line", "body"))


def line_words(body: Column) -> Column:
    """The words in order; a single space splits without a pattern, so other white space becomes one first."""
    others = SPACE_CHARS.replace(" ", "")
    rare = reduce(Column.__or__, [F.contains(body, F.lit(c)) for c in others])
    spaced = F.when(rare, F.translate(body, others, " " * len(others))).otherwise(body)
    return F.array_remove(F.split(spaced, " "), "")


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 46).cast("int")


def rarity(texts: DataFrame) -> Column:
    """For each bucket of words, the logarithm of its count, as a scalar array."""
    counted = (
        texts.select(F.explode(F.split("text", f"[{SPACE}]+")).alias("w"))
        .groupBy(_bucket(F.xxhash64("w")).alias("bucket"))
        .agg(F.floor(F.log2(F.count(F.lit(1)) + 1) * 256).cast("int").alias("level"))
    )
    return fixed_array(counted, "bucket", "level", RARITY_BUCKETS)


def _ceil_ratio(n: Column, over: int, under: int) -> Column:
    return F.floor((n * over + (under - 1)) / under).cast("int")


def line_classes(lines: DataFrame, levels: Column, percent: int, min_words: int) -> DataFrame:
    """Lines of at least `min_words` distinct words with the key of their set and what the join needs.

    A set so small that no other can be similar has no prefix: it is only ever equal to another.
    """

    def ordered(h: Column) -> Column:
        # without a null among them, numbers are sorted as such
        level = F.coalesce(F.element_at("levels", _bucket(h) + 1), F.lit(0)).cast("long")
        return F.shiftleft(level, HASH_BITS).bitwiseOR(h.bitwiseAND(F.lit(MASK)))

    def parity(acc: Column, x: Column) -> Column:
        return acc.bitwiseXOR(one_bit(F.shiftright(x, 20).bitwiseAND(F.lit(63)).cast("int")))

    def sketch(half: int) -> Column:
        own = F.filter("set", lambda x: x.bitwiseAND(F.lit(HALF)) == half)
        return F.aggregate(own, F.lit(0).cast("long"), parity)

    def least(order: int) -> Column:
        rarer = F.slice("set", F.lit(1), F.ceil(F.size("set") / 2).cast("int"))
        return F.array_min(F.transform(rarer, lambda x: x.bitwiseAND(F.lit(MASK)).bitwiseXOR(F.lit(order))))

    hashes = F.array_distinct(F.transform(line_words(F.col("body")), lambda w: F.xxhash64(w)))
    # The id keeps the filter behind this step, where the sets are made, instead of making them twice.
    sets = lines.select("*", levels.alias("levels")).select(
        "doc_id",
        "th",
        "line",
        F.monotonically_increasing_id().alias("id"),
        F.xxhash64("body").alias("lh"),
        F.sort_array(F.transform(hashes, ordered)).alias("set"),
    ).filter(F.size("set") >= min_words)
    n = F.size("set")
    return sets.select(
        "doc_id",
        "th",
        "line",
        "lh",
        "id",
        n.alias("n"),
        F.xxhash64("set").alias("key"),
        sketch(0).alias("bits"),
        F.when(n > SHORT, sketch(HALF)).otherwise(F.lit(0).cast("long")).alias("more"),
        F.transform(
            F.slice("set", F.lit(1), F.when(n * 100 >= (n + 1) * percent, n - _ceil_ratio(n, percent, 100) + 1).otherwise(0)),
            lambda x: x.bitwiseAND(F.lit(PREFIX_MASK)).cast("int"),
        ).alias("prefix"),
        F.array(*[F.xxhash64(least(ORDERS[i]), least(ORDERS[j])) for i, j in PAIRS]).alias("hashes"),
    )


def _order(side: str = "") -> Column:
    c = [F.col(f"{side}{x}") for x in ("doc_id", "th", "line")]
    return F.struct(c[0].isNull().alias("unknown"), *c)


def in_parts(scratch: Scratch, name: str, parts: int, make: Callable[[int], DataFrame]) -> DataFrame:
    """The rows of `make(part)` for all parts, stored one after the other; a part's shuffle files go before the next."""
    saved = []
    for part in range(parts):
        saved.append(scratch.save(make(part), f"{name}_{part}"))
        scratch.tidy()
    return reduce(DataFrame.union, saved)


def _in_part(key: str, parts: int, part: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)) == part


def contents_of(ids: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, body, at) of the classes in `ids`: their first lines, read from the texts, and their order."""
    wanted = classes.select("id", "doc_id", "th", "line", "lh").filter(hashed_members(ids, "id")(F.col("id")))
    wanted = scratch.save(wanted.join(ids, "id"), f"{name}_wanted")
    has_text, is_line = hashed_members(wanted, "th"), hashed_members(wanted, "lh")
    text = F.coalesce(F.col("text"), F.lit(""))
    found = lines_of(docs.filter(has_text(F.xxhash64(text)))).withColumn("lh", F.xxhash64("body"))
    place = ["th", "line", "lh"]
    # equal texts give equal lines, so one of each is enough
    found = found.filter(is_line(F.col("lh"))).join(wanted.select(*place).distinct(), place, "left_semi")
    found = found.select(*place, "body").dropDuplicates(place)
    found = wanted.join(found, place).select("id", "body", _order().alias("at"))
    found = scratch.save(found, f"{name}_contents")
    scratch.free(f"{name}_wanted")
    scratch.tidy()
    return found


def similar_to_earlier(pairs: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """The ids `late` of those pairs (late, early) whose words are similar."""
    late, early = (contents.select(F.col("id").alias(s), F.col("body").alias(f"{s}_body")) for s in ("late", "early"))
    both = pairs.select("late", "early").join(early, "early").join(late, "late")
    both = both.select("late", *[F.array_distinct(line_words(F.col(f"{s}_body"))).alias(f"{s}_words") for s in ("late", "early")])
    shared = F.size(F.array_intersect("late_words", "early_words"))
    union = F.size("late_words") + F.size("early_words") - shared
    return both.filter(shared * 100 >= union * percent).select(F.col("late").alias("id")).distinct()


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("late", "early")).alias("id")).distinct()


def line_dedup(
    docs: DataFrame, scratch: Scratch | None = None, percent: int = 80, min_words: int = 1
) -> DataFrame:
    """The columns of `docs` with the later of similar lines taken out of `text`, and n_lines, n_removed.

    Lines are what newlines separate. Similar: the sets of words have a Jaccard index of at least
    `percent` / 100. Lines with fewer than `min_words` distinct words stay, so lines without words do. Rows that repeat both id and
    text count as one document and come out alike. NULL and empty texts are untouched and have 0 and 1
    lines. Extra columns are passed on; those called n_lines or n_removed are replaced.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    lines = lines_of(texts).filter(F.btrim("body", F.lit(SPACE_CHARS)) != "")
    tagged = scratch.save(line_classes(lines, rarity(texts), percent, min_words), "lines")
    scratch.tidy()
    key = ["key", "bits", "n"]
    carried = ["doc_id", "th", "line", "id", "lh", "more", "prefix", "hashes"]
    # only lines that may be alike are dealt out; a line that no other equals is a class as it stands
    alike = scratch.save(tagged.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"), "alike")
    marked = tagged.withColumn("alike", hashed_members(alike, "key")(F.col("key")))
    whole = marked.filter(~F.col("alike")).select(*key, F.lit(1).cast("long").alias("members"), *carried)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), *carried)).alias("c")
    classes = marked.filter("alike").groupBy(*key).agg(first, F.count(F.lit(1)).alias("members"))
    classes = scratch.save(whole.union(classes.select(*key, "members", *[f"c.{c}" for c in carried])), "classes")
    scratch.free("alike")
    scratch.tidy()

    need = _ceil_ratio(F.col("a_n") + F.col("b_n"), percent, 100 + percent)
    sketch = ["n", "bits", "more"]
    both = (F.col("a_more") != 0) & (F.col("b_more") != 0)
    apart = F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits"))) + F.when(
        both, F.bit_count(F.col("a_more").bitwiseXOR(F.col("b_more")))
    ).otherwise(0)
    close = (F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent) & (apart <= F.col("a_n") + F.col("b_n") - need * 2)

    # a key of one class only brings nothing together
    hashed = classes.select(F.explode("hashes").alias("m"), "doc_id", "th", "line", "id", *sketch)
    common = scratch.save(hashed.groupBy("m").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("m"), "common")
    hashed = hashed.filter(hashed_members(common, "m")(F.col("m")))
    pivot = hashed.groupBy("m").agg(F.min(F.struct(*_order_columns(), "id", *sketch)).alias("p"), F.min("id").alias("x"), F.max("id").alias("y"))
    pivot = pivot.filter("x != y").select("m", F.col("p.id").alias("early"), *[F.col(f"p.{c}").alias(f"b_{c}") for c in sketch])
    own = hashed.select("m", F.col("id").alias("late"), *[F.col(c).alias(f"a_{c}") for c in sketch])
    first = own.join(pivot, "m").filter((F.col("late") != F.col("early")) & close)
    first = scratch.save(first.select("late", "early").distinct(), "first")
    settled = scratch.save(similar_to_earlier(first, contents_of(_ids(first), classes, texts, scratch, "first"), percent), "settled")
    scratch.free("common", "first", "first_contents")
    scratch.tidy()

    # only classes that may be settled are looked up
    some = classes.select("id", *sketch, "prefix").filter(F.size("prefix") > 0).withColumn("may", hashed_members(settled, "id")(F.col("id")))
    found = some.filter("may").join(settled.withColumn("done", F.lit(True)), "id", "left")
    some = some.filter(~F.col("may")).withColumn("done", F.lit(False)).unionByName(found.withColumn("done", F.coalesce("done", F.lit(False))))
    some = scratch.save(some.drop("may"), "state")
    scratch.tidy()
    # length, position and state of a word in one number keep its row short
    marks = F.shiftleft(F.col("n").cast("long"), 25).bitwiseOR(F.shiftleft(F.col("pos").cast("long"), 1)).bitwiseOR(F.col("done").cast("long"))
    state = some.select("id", *sketch, "done", F.posexplode("prefix").alias("pos", "w"))
    state = state.select("w", "bits", "more", "id", marks.alias("marks"))

    def read(side: str) -> DataFrame:
        # all columns of both sides agree, so that the rows are dealt out once
        return state.select(*[F.col(c).alias(f"{side}_{c}") for c in state.columns])

    def n_of(side: str) -> Column:
        return F.shiftright(f"{side}_marks", 25).cast("int")

    def rest_of(side: str) -> Column:
        return n_of(side) - F.shiftright(F.col(f"{side}_marks").bitwiseAND(F.lit((1 << 25) - 1)), 1).cast("int")

    needed = _ceil_ratio(n_of("a") + n_of("b"), percent, 100 + percent)
    meet = (
        (F.col("a_w") == F.col("b_w"))
        & ((n_of("a") < n_of("b")) | ((n_of("a") == n_of("b")) & (F.col("a_id") < F.col("b_id"))))
        & (n_of("a") * 100 >= n_of("b") * percent)
        & (F.least(rest_of("a"), rest_of("b")) >= needed)
        & (apart <= n_of("a") + n_of("b") - needed * 2)
        & (F.col("a_marks").bitwiseAND(F.col("b_marks")).bitwiseAND(F.lit(1)) == 0)
    )

    def met(part: int) -> DataFrame:
        pairs = read("a").filter(_in_part("a_w", JOIN_PARTS, part)).join(read("b").filter(_in_part("b_w", JOIN_PARTS, part)), meet)
        return pairs.select(F.col("a_id").alias("late"), F.col("b_id").alias("early"), apart.alias("apart")).distinct()

    pairs = scratch.save(in_parts(scratch, "met", JOIN_PARTS, met).distinct(), "pairs")
    scratch.free("state", *[f"met_{part}" for part in range(JOIN_PARTS)])
    scratch.tidy()
    contents = contents_of(_ids(pairs), classes, texts, scratch, "met")
    at = contents.select("id", "at")
    pairs = pairs.join(at.withColumnsRenamed({"id": "late", "at": "x"}), "late").join(at.withColumnsRenamed({"id": "early", "at": "y"}), "early")
    ahead = F.col("x") > F.col("y")
    pairs = pairs.select(
        F.when(ahead, F.col("late")).otherwise(F.col("early")).alias("late"),
        F.when(ahead, F.col("early")).otherwise(F.col("late")).alias("early"),
        "apart",
    )
    pairs = scratch.save(pairs.join(settled.withColumnRenamed("id", "late"), "late", "left_anti"), "directed")
    nearest = pairs.groupBy("late").agg(F.min(F.struct("apart", "early")).alias("p")).select("late", F.col("p.early").alias("early"))
    nearest = scratch.save(similar_to_earlier(nearest, contents, percent), "nearest")
    others = scratch.save(pairs.join(nearest.withColumnRenamed("id", "late"), "late", "left_anti"), "rest")
    some = contents.filter(hashed_members(_ids(others), "id")(F.col("id")))
    others = scratch.save(similar_to_earlier(others, some, percent), "others")
    similar = scratch.save(settled.union(nearest).union(others).distinct(), "similar")
    scratch.free("settled", "nearest", "others", "rest", "pairs", "directed", "met_contents")
    scratch.tidy()

    place = [F.col(c).alias(f"first_{c}") for c in ("doc_id", "th", "line")]
    gone = classes.filter((F.col("members") > 1) | hashed_members(similar, "id")(F.col("id")))
    gone = gone.join(similar.withColumn("similar", F.lit(True)), "id", "left").select(
        *key, "members", *place, F.coalesce("similar", F.lit(False)).alias("similar")
    )
    gone = scratch.save(gone.filter("similar or members > 1").drop("members"), "gone")
    scratch.free("classes", "similar")
    # by place and not by id, so that rows which repeat a document agree
    first = (
        F.col("doc_id").eqNullSafe(F.col("first_doc_id"))
        & (F.col("th") == F.col("first_th"))
        & (F.col("line") == F.col("first_line"))
    )
    removed = (
        tagged.select("doc_id", "th", "line", *key)
        .filter(hashed_members(gone, "key")(F.col("key")))
        .join(gone, key)
        .filter(F.col("similar") | ~first)
        .groupBy(F.col("doc_id").alias("__doc_id"), F.col("th").alias("__th"))
        .agg(F.collect_set("line").alias("__removed"))
    )
    removed = scratch.save(removed, "removed")
    scratch.free("lines", "gone")
    scratch.tidy()
    return _without(docs, removed)


def _order_columns() -> list[Column]:
    return [F.col("doc_id").isNull().alias("unknown"), F.col("doc_id"), F.col("th"), F.col("line")]


def _without(docs: DataFrame, removed: DataFrame) -> DataFrame:
    docs = docs.drop("n_lines", "n_removed")
    th = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    touched = hashed_members(removed, "__th")(th)
    split = F.split(F.col("text"), "\n")
    n_lines = F.coalesce(F.size(split), F.lit(0)).cast("long")
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(n_lines).cast("long")
    whole = docs.filter(F.col("text").isNull() | ~touched)
    whole = whole.select("*", n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    cut = docs.filter(F.col("text").isNotNull() & touched)
    cut = cut.withColumn("__key", th).join(
        removed, (F.col("__key") == F.col("__th")) & F.col("doc_id").eqNullSafe(F.col("__doc_id")), "left"
    )
    left = F.filter(split, lambda x, i: ~F.array_contains(F.col("__removed"), i))
    text = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    cut = cut.select(
        *[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        n_lines.alias("n_lines"),
        F.when(F.col("__removed").isNull(), 0).otherwise(F.size("__removed")).cast("long").alias("n_removed"),
    )
    return whole.unionByName(cut)
