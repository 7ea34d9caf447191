"""Near-equal vectors by NN-descent.

Every vector has a list of its most similar vectors so far, as far as these are within about twice the angle of
a link: what is further away leads to no link. The first lists come from a forest: each tree cuts the vectors of
a group in halves by random projections, and those that stay together in a leaf are all compared. The number of
trees follows from the depth and the spread: a pair at the threshold is parted by all of them about once in 2,000 times. In a round,
the vectors on a vector's list and those that have it on theirs are compared with each other, which finds
neighbours of neighbours; rounds end when hardly any list changes. Links are what passes the threshold. All
members of a component are compared exactly, in blocks. A list whose every entry passes is saturated, and may
lack members that no list holds. A link that is missing for this reason has saturated lists at both ends, so the
saturated vectors of a group are covered by leaders and the leaders are compared with each other, in blocks, by a
bound that no link escapes. One in EVERY vectors is compared with all rows of its group, in blocks, to audit the
recall: on average over the vectors with few and with many links, in each group. While it is too low in some groups,
these get another forest, lists are widened and the descent goes on; groups where it stays too low are compared
whole, in blocks.

Vectors are compared only within a group (equal label and length). Equal vectors are one class. Only vectors
whose hash comes twice are grouped to find these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upliftlens.llm.common import hashed_members, map_arrow, mix64, Scratch
from upliftlens.llm.components import components

LIST = 12
#: Vectors of a group that a tree leaves together, and those that a task gets together, about and at most.
LEAF, BUCKET, MOST = 1024, 8192, 200_000
#: The share of pairs at the threshold that all trees may part, and trees at most.
PARTED, TREES = 0.0005, 16
#: About so many vectors of a group tell where its medians lie, and so many how far it spreads.
SAMPLE, FEW = 512, 128
OFFERS = 4
ROUNDS = 12
#: Rounds end when fewer than this share of all list entries are new.
STILL = 0.002
#: The descent works on half-precision copies; what it finds this far below the threshold is checked.
MARGIN = 0.005
#: Classes of a block in small and in large components, and blocks that a component has before they grow.
BLOCK, LARGE, BLOCKS = 512, 4096, 16
#: Classes of a block of the audit, whose blocks each meet all of the other kind.
AUDITED = 16_384
#: Rows that are compared at once.
ROWS = 512
#: The cosine of a leader to the vectors that it stands for.
NEAR = 0.999
#: One in so many vectors, and at least about so many, are compared with all rows to audit the recall.
EVERY, AUDIT = 50, 256
RECALL, WIDER = 0.995, 3
#: Groups that are compared side by side.
SIDE = 1024

PAIR = "a long, b long, sim float"


def near_vectors(vectors: DataFrame, scratch: Scratch | None = None, threshold: float = 0.98) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, n_links, component_id, kept, one row per row.

    Links are pairs of other rows with the same non-NULL label and a cosine of at least `threshold`, in
    double precision. Vectors that are NULL, empty, zero or hold NULL or non-finite components, and rows
    without a vec_id, link with nothing and are kept. Vectors of different length are never linked.
    Other columns are ignored.
    """
    scratch = scratch or Scratch(vectors.sparkSession)
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), _wide(vectors.schema["embedding"].dataType).alias("v"), F.col("label")
    )
    # what is equal has one hash; a hash that comes once needs no look at the others
    rows = rows.withColumn("h", F.xxhash64("label", "v"))
    again = hashed_members(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "h")
    least, most = F.array_min("v"), F.array_max("v")  # NaN counts as the greatest
    infinite = F.array_contains("v", float("inf"))  # NULL if there is a NULL instead
    fine = ~infinite & ~F.isnan(most) & (least > float("-inf")) & ((least != 0) | (most != 0))
    fine = F.coalesce(fine, F.lit(False))
    fine = fine & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    rows = rows.withColumn("g", F.when(fine, F.xxhash64("label", F.size("v"))))
    alone = scratch.save(rows.filter("g is null").select("vec_id"), "alone")
    rows = rows.filter("g is not null").select("vec_id", "g", (~again(F.col("h"))).alias("single"), "v")
    rows = scratch.save(map_arrow(rows, _packed, "vec_id long, g long, single boolean, v binary"), "rows")
    several = rows.filter("not single")
    repeated = scratch.save(several.groupBy("g", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")), "repeated")
    one = F.lit(1).cast("long").alias("n")
    classes = rows.filter("single").select("g", "v", F.col("vec_id").alias("id"), one).union(repeated)

    sizes = scratch.save(classes.groupBy("g").agg(F.count(F.lit(1)).alias("members")), "sizes")
    total = sizes.agg(F.sum("members")).first()[0] or 0
    width, audit, lists, low = LIST, None, None, None
    for attempt in range(WIDER):
        lists, held = _first_lists(classes, sizes, lists, low, scratch, threshold, width, attempt)
        lists = _descend(held, lists, scratch, width, held.count(), threshold)
        links = lists.filter(F.col("sim") >= threshold - MARGIN).select("a", "b")
        if audit is not None:
            links = links.union(audit)
        checked, exact = _enlarged(classes, links, scratch, threshold)
        bridges = _bridges(classes, lists, exact, scratch, threshold, width)
        if bridges.take(1):
            links = links.union(bridges)
            checked, exact = _enlarged(classes, links, scratch, threshold)
        hits, judged = _audit(classes, checked, scratch, threshold, attempt, total)
        audit = hits if audit is None else audit.union(hits)
        low = judged.filter(F.col("recall") < RECALL).select("g").distinct()
        if not low.take(1):
            break
        width *= 2
    if judged.filter("recall < 1").take(1):  # what the audit saw counts as found, and groups that failed are compared whole
        checked, exact = _enlarged(classes, links.union(audit), scratch, threshold, low)

    part = components(exact, scratch, "parts")
    linked = scratch.save(checked.join(part, "id", "left"), "linked")
    members = several.join(repeated, ["g", "v"]).select("vec_id", "id", "n")
    members = rows.filter("single").select("vec_id", F.col("vec_id").alias("id"), one).union(members)
    every = members.join(linked, "id", "left").select(
        "vec_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return every.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _wide(kind: T.DataType) -> Column:
    """The vectors; numbers that aren't floating-point become doubles."""
    plain = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType | T.DoubleType)
    return F.col("embedding") if plain else F.col("embedding").cast("array<double>")


def _binary(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as bytes."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of bytes of one length as a matrix."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1)


def _lengths(column: pa.Array) -> np.ndarray:
    return pa.compute.binary_length(column).to_numpy(zero_copy_only=False)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as the bytes of their numbers, after one byte that tells the bytes of a number; equal vectors have equal bytes."""
    for batch in batches:
        size = np.diff(np.asarray(batch.column("v").offsets))
        for length in np.unique(size):
            part = batch.filter(pa.array(size == length))
            x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1) + 0.0  # no negative zero
            raw = np.concatenate([np.full((len(x), 1), x.itemsize, np.uint8), x.view(np.uint8).reshape(len(x), -1)], axis=1)
            yield pa.record_batch([*[part.column(c) for c in ("vec_id", "g", "single")], _binary(raw)], names=["vec_id", "g", "single", "v"])


def _units(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1, in double precision."""
    raw = _matrix(column)
    x = np.ascontiguousarray(raw[:, 1:]).view(np.float32 if raw[0, 0] == 4 else np.float64).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _passing(x: np.ndarray, y: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """Which rows of x and y have a cosine of at least `least` in double precision, a few rows of x at a time.

    Rows of x without any are left out. Single precision is surely right further than `unsure` from the bound.
    """
    unsure = np.float32((x.shape[1] + 8) * 2.0**-23)
    least32 = np.float32(least)
    low, high = x.astype(np.float32), np.ascontiguousarray(y.astype(np.float32).T)
    for start in range(0, len(x), ROWS):
        sim = low[start : start + ROWS] @ high
        part = sim >= least32 - unsure
        if part.any():
            i, j = np.divmod(np.flatnonzero(part & (sim < least32 + unsure)), part.shape[1])
            for s in range(0, len(i), 100_000):
                p, q = i[s : s + 100_000], j[s : s + 100_000]
                part[p, q] = np.einsum("ij,ij->i", x[start + p], y[q]) >= least
            yield start, part


def _trees(members: np.ndarray, parted: np.ndarray) -> np.ndarray:
    """Trees that groups of so many members get, if a cut parts so many pairs at the threshold; one leaf needs one tree."""
    depth = np.maximum(0, np.log2(np.maximum(members, 1) / LEAF))
    trees = np.ceil(np.log(PARTED) / np.log(np.maximum(1 - (1 - parted) ** depth, 1e-12)))
    return np.where(members > 1, np.clip(trees, 1, TREES), 0).astype(np.int64)


def _bits(members: np.ndarray) -> np.ndarray:
    """Cuts that leave about BUCKET of so many members together."""
    return np.ceil(np.log2(np.maximum(members, 1) / BUCKET)).clip(0).astype(np.int64)


def _floor(threshold: float) -> float:
    """The cosine of twice the angle of the threshold."""
    return float(np.cos(min(np.pi, 2 * np.arccos(threshold))))


def _directions(length: int, trees: int, bits: int, turn: int) -> np.ndarray:
    return np.random.default_rng([length, turn]).normal(size=(TREES * bits, length))[: trees * bits].T


def _spread(bits: int, turn: int, threshold: float):
    """For each group (g), by its sample: the medians along each direction, and the share of pairs at the threshold that a cut parts.

    Along a direction, the ends of such a pair are about their distance apart; they are parted if the median is between them.
    """
    angle = np.arccos(min(1.0, threshold))
    apart = 2 * np.sin(angle / 2) * np.sqrt(2 / np.pi)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "g", 1):
            g = table["g"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                x = _units(table["v"].slice(start, end - start).combine_chunks())
                cuts = np.median(x @ _directions(x.shape[1], TREES, bits, turn), axis=0).astype(np.float32)
                low, high = np.quantile(x @ _directions(x.shape[1], TREES, 1, turn), [0.4, 0.6], axis=0)
                parted = np.clip(apart * 0.2 / max(float(np.median(high - low)), 1e-9), angle / np.pi, 0.25)
                columns = [pa.array(g[start : start + 1]), pa.array([cuts.tolist()], pa.list_(pa.float32())), pa.array([parted])]
                yield pa.record_batch(columns, names=["g", "cuts", "parted"])

    return run


def _halves(trees: int, bits: int, turn: int):
    """Half-precision copies, and for each tree the bucket that the vector is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = _lengths(batch.column("v"))
            for bytes_ in np.unique(size):
                part = batch.filter(pa.array(size == bytes_))
                x, members = _units(part.column("v")), part.column("members").to_numpy()
                own = np.where(part.column("cuts").is_valid().to_numpy(zero_copy_only=False), _bits(members), 0)
                code = np.zeros((len(x), trees), np.uint64)
                if own.any():
                    large = np.flatnonzero(own)
                    cuts = part.column("cuts").take(pa.array(large)).flatten().to_numpy().reshape(len(large), -1)
                    above = (x[large] @ _directions(x.shape[1], trees, bits, turn) > cuts).reshape(len(large), trees, bits)
                    for b in range(bits):
                        code[large] += (above[:, :, b] & (own[large] > b)[:, None]).astype(np.uint64) << np.uint64(b)
                g = part.column("g").to_numpy().view(np.uint64)
                key = mix64(mix64(code + np.uint64(1)) + g[:, None]).view(np.int64)
                mine = np.minimum(trees, _trees(members, part.column("parted").to_numpy()))
                yield pa.record_batch(
                    [
                        part.column("g"),
                        part.column("id"),
                        _binary(x.astype(np.float16)),
                        *[pa.array(key[:, t], mask=mine <= t) for t in range(trees)],
                    ],
                    names=["g", "id", "h", *[f"k{t}" for t in range(trees)]],
                )

    return run


def _groups(batches: Iterator[pa.RecordBatch], key: str, least: int = 20_000, most: int = 2**62) -> Iterator[pa.Table]:
    """Rows sorted by `key` as tables that never cut a key, unless it has more than `most` rows."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table[key].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield table.slice(0, cut)
            held, count = table.slice(cut).to_batches(), len(table) - cut
        elif count > most:
            yield table
            held, count = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _leaves(seed: int, width: int, least: float):
    """Cut each bucket in halves by random projections down to leaves; offer each vector the best of its leaf."""

    def leaf(x: np.ndarray, ids: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        sim = x[own] @ x[own].T
        np.fill_diagonal(sim, -3)
        i, j = np.divmod(np.flatnonzero(sim >= least), len(own))
        count = np.bincount(i, minlength=len(own))
        many = np.flatnonzero(count > width)
        if len(many):
            top = np.argpartition(-sim[many], width - 1, axis=1)[:, :width]
            few = count[i] <= width
            i, j = np.concatenate([i[few], np.repeat(many, width)]), np.concatenate([j[few], top.ravel()])
        if len(i):
            yield _pairs(ids[own[i]], ids[own[j]], sim[i, j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "k", most=MOST):
            k, g, ids = (table[c].to_numpy() for c in ("k", "g", "id"))
            h = table["h"].combine_chunks()
            edges = [0, *(np.flatnonzero((np.diff(k) != 0) | (np.diff(g) != 0)) + 1).tolist(), len(k)]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if end - start < 2:
                    continue
                x = _matrix(h.slice(start, end - start)).view(np.float16).astype(np.float32)
                rng = np.random.default_rng([seed, abs(int(k[start]))])
                stack = [np.arange(end - start)]
                while stack:
                    own = stack.pop()
                    if len(own) <= LEAF:
                        yield from leaf(x, ids[start:end], own)
                        continue
                    along = x[own] @ rng.normal(size=x.shape[1]).astype(np.float32)
                    order = np.argpartition(along, len(own) // 2)
                    stack += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]

    return run


def _pairs(a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim, pa.float32())], names=["a", "b", "sim"])


def _first_lists(
    classes: DataFrame, sizes: DataFrame, lists: DataFrame | None, low: DataFrame | None, scratch: Scratch, threshold: float, width: int, turn: int
) -> tuple[DataFrame, DataFrame]:
    """Lists from a forest over all groups, or over those in `low` (g) besides `lists`; half-precision copies of who is on them."""
    if low is not None:
        sizes = sizes.join(low, "g", "left_semi")
    most = int(sizes.agg(F.max("members")).first()[0] or 0)
    bits, least = int(_bits(np.array([most]))[0]), _floor(threshold)
    straight = F.lit(float(np.arccos(min(1.0, threshold)) / np.pi))
    one_in = F.floor(F.col("members") / F.when(F.col("members") > BUCKET, SAMPLE).otherwise(FEW))
    seen = classes.join(sizes.filter(F.col("members") > LEAF), "g").filter(F.pmod(F.xxhash64("id", F.lit(turn)), one_in) == 0)
    seen = seen.select("g", "v").repartition("g").sortWithinPartitions("g")
    seen = map_arrow(seen, _spread(bits, turn, threshold), "g long, cuts array<float>, parted double")
    plan = sizes.join(seen, "g", "left").withColumn("parted", F.coalesce("parted", straight))
    plan = scratch.save(plan, f"plan_{turn}")
    parted = plan.agg(F.max("parted")).first()[0] or 0.0
    trees = max(1, int(_trees(np.array([most]), np.array([parted]))[0]))
    plan = plan.withColumn("cuts", F.when(F.col("members") > BUCKET, F.slice("cuts", 1, max(1, trees * bits))))
    keys = [f"k{t}" for t in range(trees)]
    known = classes.join(plan.filter("members > 1"), "g").select("g", "id", "v", "members", "cuts", "parted")
    half = map_arrow(known, _halves(trees, bits, turn), "g long, id long, h binary, " + ", ".join(f"{k} long" for k in keys))
    half = scratch.save(half, f"half_{turn}")
    offers = lists.withColumn("old", F.lit(True)) if lists is not None else None
    for t, key in enumerate(keys):
        dealt = half.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), "g", "id", "h")
        dealt = dealt.repartition("k").sortWithinPartitions("k", "g")
        part = scratch.save(map_arrow(dealt, _leaves(turn * TREES + t, width, least), PAIR), f"tree_{turn}_{t}")
        part = part.withColumn("old", F.lit(False))
        offers = part if offers is None else offers.union(part)
        scratch.tidy()  # a tree's shuffle holds all vectors
    lists = scratch.save(_best(offers, width), f"lists_0_{turn}")
    named = half.select("id", "h")
    if turn:
        named = named.union(scratch.spark.read.schema("id long, h binary").parquet(f"{scratch.root}/held_{turn - 1}"))
        named = named.groupBy("id").agg(F.min("h").alias("h"))
    on = lists.select(F.col("a").alias("id")).distinct()
    held = named.filter(hashed_members(on, "id")(F.col("id"))).join(on, "id", "left_semi")
    return lists, scratch.save(held, f"held_{turn}")


def _best(offers: DataFrame, width: int) -> DataFrame:
    """The `width` most similar of each list; an entry that was there before counts as old."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "a"):
            a, b, sim, old = (table[c].to_numpy() for c in ("a", "b", "sim", "old"))
            order = np.lexsort((~old, b, a))
            a, b, sim, old = a[order], b[order], sim[order], old[order]
            once = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            a, b, sim, old = a[once], b[once], sim[once], old[once]
            order = np.lexsort((b, -sim, a))
            a, b, sim, old = a[order], b[order], sim[order], old[order]
            begin = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1])
            rank = np.arange(len(a)) - np.repeat(begin, np.diff([*begin, len(a)]))
            top = rank < width
            yield pa.record_batch(
                [pa.array(a[top]), pa.array(b[top]), pa.array(sim[top]), pa.array(old[top])], names=["a", "b", "sim", "old"]
            )

    return map_arrow(offers.repartition("a").sortWithinPartitions("a"), run, f"{PAIR}, old boolean")


def _descend(half: DataFrame, lists: DataFrame, scratch: Scratch, width: int, total: int, threshold: float) -> DataFrame:
    """Rounds over the vectors on lists. Saturated lists stay as they are, as better entries would add no link."""
    for step in range(1, ROUNDS + 1):
        turn = F.row_number().over(Window.partitionBy("v").orderBy(F.xxhash64("u", F.lit(step)), "u"))
        forward = lists.select(F.col("a").alias("v"), F.col("b").alias("u"), "old")
        back = lists.select(F.col("b").alias("v"), F.col("a").alias("u"), "old")
        back = back.withColumn("turn", turn).filter(F.col("turn") <= width).drop("turn")
        lowest = lists.groupBy("a").agg(F.min("sim").alias("low"), F.count(F.lit(1)).alias("n"))
        full = F.when(F.col("low") >= threshold - MARGIN, F.lit(9.0)).otherwise(F.col("low"))
        known = half.select("id", "h").join(lowest, F.col("id") == F.col("a"), "left").select(
            F.col("id").alias("u"), "h", F.when(F.col("n") >= width, full).otherwise(F.lit(_floor(threshold))).cast("float").alias("low")
        )
        members = forward.union(back).groupBy("v", "u").agg(F.min("old").alias("old")).join(known, "u")
        offers = map_arrow(members.repartition("v").sortWithinPartitions("v", "u"), _compare, PAIR)
        offers = offers.withColumn("old", F.lit(False)).union(lists.withColumn("old", F.lit(True)))
        lists = scratch.save(_best(offers, width), f"lists_{step % 2 + 1}")
        if lists.filter("not old").count() <= STILL * width * total:
            break
    return lists


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the members of each group; offer each the best of the others that would enter its list."""
    for table in _groups(batches, "v"):
        v = table["v"].to_numpy()
        begins = np.concatenate([[0], np.flatnonzero(v[1:] != v[:-1]) + 1])
        sizes = np.diff([*begins, len(v)])
        u, old, low = table["u"].to_numpy(), table["old"].to_numpy(), table["low"].to_numpy()
        h = table["h"].combine_chunks()
        lengths = _lengths(h)
        for s in range(0, len(begins), SIDE):
            size = sizes[s : s + SIDE]
            first, last = begins[s], begins[s] + size.sum()
            most = int(size.max())
            # groups are within one group of vectors, but two groups here may differ in length
            dimension = int(lengths[first:last].max()) // 2
            flat = np.zeros((last - first, dimension), np.float32)
            for length in np.unique(lengths[first:last]):
                at = np.flatnonzero(lengths[first:last] == length)
                flat[at, : length // 2] = _matrix(h.take(pa.array(first + at))).view(np.float16)
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(last - first) - np.repeat(np.cumsum(size) - size, size)
            x = np.zeros((len(size), most, dimension), np.float32)
            x[row, place] = flat
            fresh, ids, floor = np.zeros((len(size), most), bool), np.zeros((len(size), most), np.int64), np.full((len(size), most), 9, np.float32)
            real = np.zeros((len(size), most), bool)
            real[row, place], fresh[row, place] = True, ~old[first:last]
            ids[row, place], floor[row, place] = u[first:last], low[first:last]
            sim = np.matmul(x, x.transpose(0, 2, 1))
            open_ = real[:, :, None] & real[:, None, :] & (fresh[:, :, None] | fresh[:, None, :]) & (sim > floor[:, :, None])
            open_ &= ~np.eye(most, dtype=bool)[None]
            sim = np.where(open_, sim, np.float32(-3))
            keep = min(OFFERS, most)
            top = np.argpartition(-sim, keep - 1, axis=2)[:, :, :keep]
            value = np.take_along_axis(sim, top, axis=2)
            r, i, k = np.nonzero(value > -2.5)
            yield _pairs(ids[r, i], ids[r, top[r, i, k]], value[r, i, k])


def _dealt(part: DataFrame, members: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Members (component, id, v, n) as pieces of work: each pair of blocks of each component of `part`."""
    count = F.count(F.lit(1))
    size = F.least(F.lit(LARGE), F.greatest(F.lit(BLOCK), F.ceil(count / BLOCKS)))
    sized = part.groupBy("component").agg(F.ceil(count / size).cast("int").alias("blocks"))
    sized = scratch.save(sized, f"{name}_sizes")
    block = F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int")
    dealt = members.join(sized, "component").withColumn("block", block).select(
        "component", "id", "v", "n", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    )
    dealt = dealt.select(
        F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("work"),
        "component",
        F.least("block", "other").alias("x"),
        F.greatest("block", "other").alias("y"),
        "block",
        "id",
        "v",
        "n",
    )
    return dealt.repartition("work").sortWithinPartitions("work", "component", "x", "y")


def _pieces(table: pa.Table) -> Iterator[tuple]:
    """The vectors, ids and n of each piece of work, and the places of its two blocks, which may be one."""
    keys = np.stack([table[c].to_numpy() for c in ("work", "component", "x", "y")], axis=1)
    begins = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1])
    for first, last in zip(begins, [*begins[1:], len(keys)], strict=True):
        part = table.slice(first, last - first)
        block, (_, _, low, high) = part["block"].to_numpy(), keys[first]
        one = np.flatnonzero(block == low)
        two = one if low == high else np.flatnonzero(block == high)
        yield _units(part["v"].combine_chunks()), part["id"].to_numpy(), part["n"].to_numpy(), one, two


def _linked(x: np.ndarray, key: np.ndarray, one: np.ndarray, two: np.ndarray, least: float) -> np.ndarray:
    """Which of two blocks are linked, if their keys differ."""
    linked = np.zeros((len(one), len(two)), bool)
    for start, part in _passing(x[one], x[two], least):
        rows = slice(start, start + len(part))
        linked[rows] = part & (key[one[rows]][:, None] != key[two][None])
    return linked


def _weigh(linked: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sum of n over the links of each row."""
    if (n == 1).all():
        return np.count_nonzero(linked, axis=1)
    parts = [linked[s : s + ROWS].astype(np.float64) @ n.astype(np.float64) for s in range(0, len(linked), ROWS)]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def _of(ids: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes of a table of ids, joined to it; few others are shuffled."""
    return ids.join(classes.filter(hashed_members(ids.select("id"), "id")(F.col("id"))), "id")


def _bridges(
    classes: DataFrame, lists: DataFrame, exact: DataFrame, scratch: Scratch, threshold: float, width: int
) -> DataFrame:
    """Pairs (a, b) that connect components which may have a link between saturated vectors.

    In blocks of each component, leaders are taken until each saturated vector has one at a cosine of NEAR.
    Two linked vectors have leaders at no more than the angle of the threshold and twice that of NEAR.
    """
    full = lists.groupBy("a").agg(F.count(F.lit(1)).alias("size"), F.min("sim").alias("low"))
    full = full.filter((F.col("size") >= width) & (F.col("low") >= threshold - MARGIN)).select(F.col("a").alias("id"))
    part = full.join(components(exact, scratch, "tight"), "id", "left")
    part = scratch.save(part.select("id", F.coalesce("component", "id").alias("component")), "saturated")
    rows = _of(part, classes.select("id", "g", "v"))
    several = rows.groupBy("g").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    rows = rows.join(several.filter("least < most").select("g"), "g", "left_semi")
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / BLOCK)).cast("int")
    sized = part.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    rows = rows.join(sized, "component").withColumn("work", F.xxhash64("component", block))

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "work", 2000):
            keys = np.stack([table[c].to_numpy() for c in ("work", "component")], axis=1)
            begins = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1])
            for first, last in zip(begins, [*begins[1:], len(keys)], strict=True):
                piece = table.slice(first, last - first).combine_chunks()
                x = _units(piece["v"].combine_chunks())
                close = x @ x.T >= NEAR
                alone, chosen = np.ones(len(x), bool), []
                while alone.any():
                    chosen.append(int(alone.argmax()))
                    alone &= ~close[chosen[-1]]
                    alone[chosen[-1]] = False
                yield from piece.select(["g", "component", "id", "v"]).take(chosen).to_batches()

    chosen = rows.select("work", "component", "g", "id", "v").repartition("work").sortWithinPartitions("work", "component")
    leaders = scratch.save(map_arrow(chosen, lead, "g long, component long, id long, v binary"), "leaders")
    low = float(np.cos(np.arccos(threshold) + 2 * np.arccos(NEAR))) - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "work", 2000):
            for x, ids, own, one, two in _pieces(table):
                i, j = _spanning(_linked(x, own, one, two, low), one, two, len(ids))
                yield pa.record_batch([pa.array(ids[i]), pa.array(ids[j])], names=["a", "b"])

    own = leaders.select(F.col("g").alias("component"), "id", "v", F.col("component").alias("n"))
    dealt = _dealt(own.select("component"), own, scratch, "leaders")
    return scratch.save(map_arrow(dealt, run, "a long, b long"), "bridges")


def _enlarged(
    classes: DataFrame, links: DataFrame, scratch: Scratch, threshold: float, whole: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Exact links inside the components of `links`: (id, links), and edges that span them.

    A group that is in `whole` (g) counts as one component.

    A component is dealt into blocks of BLOCK to LARGE classes, and each pair of blocks is one piece of work.
    """
    part = components(links, scratch, "rough")
    if whole is not None:
        own = classes.select("g", "id").join(whole, "g")
        one = own.join(own.groupBy("g").agg(F.min("id").alias("component")), "g").select("id", "component")
        part = scratch.save(part.join(one, "id", "left_anti").unionByName(one), "rough_whole")
    dealt = _dealt(part, _of(part, classes.select("id", "v", "n")), scratch, "rough")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "work", 2000):
            for x, ids, n, one, two in _pieces(table):
                linked = _linked(x, ids, one, two, threshold)
                count = np.zeros(len(ids), np.int64)
                count[one] += _weigh(linked, n[two])
                if one is not two:
                    count[two] += _weigh(linked.T, n[one])
                i, j = _spanning(linked, one, two, len(ids))
                yield _counted(ids, count, ids)
                yield _counted(ids[i], np.zeros(len(i), np.int64), ids[j])

    done = map_arrow(dealt, run, "id long, links long, other long")
    done = scratch.save(done, "enlarged")
    counts = scratch.save(done.groupBy("id").agg(F.sum("links").alias("links")), "links")
    edges = done.filter("id != other").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()
    return counts, scratch.save(edges, "edges")


def _counted(ids: np.ndarray, links: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(ids), pa.array(links), pa.array(other)], names=["id", "links", "other"])


def _spanning(linked: np.ndarray, one: np.ndarray, two: np.ndarray, n: int) -> tuple[list, list]:
    """Links that connect whatever the matrix connects: at most one for each row."""
    seen = np.ones(n, bool)
    seen[one[linked.any(axis=1)]] = False
    seen[two[linked.any(axis=0)]] = False
    rows, columns = [], []
    at_one = np.full(n, -1)
    at_one[one] = np.arange(len(one))
    at_two = np.full(n, -1)
    at_two[two] = np.arange(len(two))
    for root in np.flatnonzero(~seen).tolist():
        if seen[root]:
            continue
        seen[root], queue = True, [root]
        while queue:
            i = queue.pop()
            near = np.zeros(n, bool)
            if at_one[i] >= 0:
                near[two] |= linked[at_one[i]]
            if at_two[i] >= 0:
                near[one] |= linked[:, at_two[i]]
            fresh = np.flatnonzero(near & ~seen)
            seen[fresh] = True
            rows += [i] * len(fresh)
            columns += fresh.tolist()
            queue += fresh.tolist()
    return rows, columns


def _audit(
    classes: DataFrame, checked: DataFrame, scratch: Scratch, threshold: float, turn: int, total: int
) -> tuple[DataFrame, DataFrame]:
    """Compare a sample of classes with all of their groups: links that span what was seen, and the recall.

    The recall (g, large, recall) is the mean, over the sampled classes of a group with at most and with
    more than LIST links, of the share of their links that was found. Each turn has another sample, as what
    an earlier one saw is among the links.
    """
    few = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(max(1, total // max(1, AUDIT)))) == 0 if AUDIT else F.lit(False)
    chosen = (F.pmod("id", F.lit(EVERY)) == turn) | few
    marked = classes.select("g", "id", "v", "n", chosen.alias("chosen"))
    block = F.ceil(F.count(F.lit(1)) / AUDITED).cast("int")
    sizes = marked.groupBy("g").agg(block.alias("blocks"), F.ceil(F.count_if("chosen") / AUDITED).cast("int").alias("samples"))
    sizes = scratch.save(sizes.filter("samples > 0"), f"audit_sizes_{turn}")

    def dealt(rows: DataFrame, own: str, other: str, sampled: bool) -> DataFrame:
        place = F.pmod(F.xxhash64("id"), F.col(own).cast("long")).cast("int").alias(own)
        rows = rows.join(sizes, "g").select(
            "g", "id", "v", "n", place, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)
        )
        return rows.select(
            F.xxhash64("g", "blocks", "samples").alias("work"), "g", "blocks", "samples", "id", "v", "n", F.lit(sampled).alias("sampled")
        )

    work = dealt(marked, "blocks", "samples", False).union(dealt(marked.filter("chosen"), "samples", "blocks", True))
    work = work.repartition("work").sortWithinPartitions("work", "g", "blocks", "samples")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "work", 2000):
            keys = np.stack([table[c].to_numpy() for c in ("work", "g", "blocks", "samples")], axis=1)
            begins = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1])
            for first, last in zip(begins, [*begins[1:], len(keys)], strict=True):
                part = table.slice(first, last - first)
                x, ids, n = _units(part["v"].combine_chunks()), part["id"].to_numpy(), part["n"].to_numpy()
                sampled = part["sampled"].to_numpy()
                every, two = np.flatnonzero(sampled), np.flatnonzero(~sampled)
                for s in range(0, len(every), LARGE):
                    one = every[s : s + LARGE]
                    linked = _linked(x, ids, one, two, threshold)
                    i, j = _spanning(linked, one, two, len(ids))
                    yield _counted(ids[one], _weigh(linked, n[two]), ids[one])
                    yield _counted(ids[i], np.zeros(len(i), np.int64), ids[j])

    seen = scratch.save(map_arrow(work, run, "id long, links long, other long"), f"audit_{turn}")
    true = seen.filter("id = other").groupBy("id").agg(F.sum("links").alias("n")).filter("n > 0")
    found = F.least("n", F.coalesce("links", F.lit(0))) / F.col("n")
    judged = true.join(checked, "id", "left").join(classes.select("id", "g"), "id")
    judged = judged.groupBy("g", (F.col("n") > LIST).alias("large")).agg(F.avg(found).alias("recall"))
    hits = seen.filter("id != other").select(F.col("id").alias("a"), F.col("other").alias("b"))
    return hits, scratch.save(judged, f"judged_{turn}")
