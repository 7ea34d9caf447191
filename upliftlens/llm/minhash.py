"""Near-duplicate documents by a multi-index Hamming join of b-bit min-hash signatures.

A document is the set of its word shingles; documents with equal sets are one class. A class has a
signature of CHUNKS * WIDTH symbols of 16 bits. Two signatures that differ in at most LIMIT = 2 * CHUNKS - 1
symbols differ in at most one symbol in some chunk (pigeonhole). So every chunk is indexed once for each
position in which it may be wrong, with that symbol left out: the pairs that meet under such a key include
all pairs up to that distance, and pairs beyond it are left out where they meet. So are pairs whose sizes, or
whose parity sketches of all shingles, show that they can't be linked; both tests are exact, and no text moves
for them. What is left is confirmed on the words themselves.

Only the components matter, so pairs inside a component need no check. In a few rounds each class is tried
against the nearest of the pivots of its keys, a member for each key and round, and what links is merged. That
joins the members of large groups of near copies by a few pairs each. Then, under each key, the classes outside
the key's largest component meet all others, and the pairs of two components are confirmed from the
nearest on, until the components are one or all their pairs are done.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from upliftlens.llm.common import Scratch, hashed_members, map_arrow, mix64, slices, word_codes
from upliftlens.llm.components import components

CHUNKS, WIDTH = 9, 4
#: Pairs whose signatures differ in at most so many symbols are candidates, all of them.
LIMIT = 2 * CHUNKS - 1
#: Signatures are held as longs of four symbols.
LONGS = -(-CHUNKS * WIDTH // 4)
PARTS = [f"s{i}" for i in range(LONGS)]
#: The parity of the shingles in each of 256 buckets, as longs.
SKETCH = [f"p{i}" for i in range(4)]
ABOUT = ["n", *SKETCH, *PARTS]
#: Rounds of pivots, and how many of the nearest pivots a class is tried against in each.
ROUNDS, TRIES = 2, 2
#: Members of a key that meet the others at once, and comparisons that one task is to make, about.
PIECE, WORK = 2048, 20_000_000
#: Comparisons made at once by a task.
CELLS = 500_000
PERMUTATIONS = np.random.default_rng(20240607).integers(1, 2**63, size=(2, CHUNKS * WIDTH), dtype=np.uint64) | np.uint64(1)
BLOCK = 1 << 18

SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, " + ", ".join(f"{p} long" for p in SKETCH + PARTS)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each text, sorted, one text after the other, and the offsets."""
    codes, offsets, vocabulary = word_codes(pa.compute.ascii_lower(pa.compute.fill_null(texts, "")))
    hashes = np.fromiter(
        (xxhash.xxh3_64_intdigest(w.as_buffer()) for w in vocabulary), np.uint64, len(vocabulary)
    )
    word = hashes[codes]
    n = len(word)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):  # the shingle that begins at each word
        rolled[: n - k] = mix64(rolled[: n - k] * np.uint64(3) + word[k:] + np.uint64(k + 1))
    sets, ends = [], [0]
    for start, end in zip(offsets[:-1], offsets[1:], strict=True):
        if end - start >= size:
            own = np.unique(rolled[start : end - size + 1])
        elif end > start:  # a short text is one shingle of all its words
            h = np.zeros(1, np.uint64)
            for k, w in enumerate(word[start:end]):
                h = mix64(h * np.uint64(3) + w + np.uint64(k + 1))
            own = h + np.uint64(end - start)
        else:
            own = rolled[:0]
        sets.append(own)
        ends.append(ends[-1] + len(own))
    return np.concatenate(sets) if sets else rolled[:0], np.array(ends, np.int64)


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each non-empty set, 16 bits of the smallest member under each permutation."""
    starts = offsets[:-1]
    out = np.empty((len(starts), PERMUTATIONS.shape[1]), np.uint16)
    first = 0
    while first < len(starts):  # as many sets at a time as stay in the cache
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, side="right")) - 1)
        part = hashes[offsets[first] : offsets[last]]
        begins = starts[first:last] - offsets[first]
        for i in range(PERMUTATIONS.shape[1]):
            low = np.minimum.reduceat((part ^ PERMUTATIONS[0, i]) * PERMUTATIONS[1, i], begins)
            out[first:last, i] = (low >> np.uint64(20)).astype(np.uint16)
        first = last
    return out


def _sign(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, offsets = shingle_sets(batch.column("text"), shingle)
            n = np.diff(offsets)
            full = np.flatnonzero(n)
            tight = np.concatenate([[0], np.cumsum(n[full])])
            sig = signatures(hashes, tight)
            a, b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(full):  # two sums over the members identify the set
                a[full] = np.add.reduceat(mix64(hashes), tight[:-1])
                b[full] = np.add.reduceat(mix64(hashes ^ np.uint64(0xD6E8FEB86659FD93)), tight[:-1])
            packed = np.zeros((len(n), 4 * LONGS), np.uint16)
            packed[full, : CHUNKS * WIDTH] = sig
            longs = packed.view(np.int64)
            place = np.repeat(np.arange(len(n)) * 256, n) + (hashes >> np.uint64(7)).astype(np.uint8)
            odd = (np.bincount(place, minlength=256 * len(n)) & 1).astype(np.uint8).reshape(len(n), 256)
            parity = np.packbits(odd, axis=1).view(np.int64)
            yield pa.record_batch(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(n.astype(np.int64)),
                    pa.array(a.view(np.int64)),
                    pa.array(b.view(np.int64)),
                    *[pa.array(np.ascontiguousarray(parity[:, i])) for i in range(len(SKETCH))],
                    *[pa.array(np.ascontiguousarray(longs[:, i])) for i in range(LONGS)],
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", *SKETCH, *PARTS],
            )

    return run


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each key: a chunk of the signature without one of its symbols."""
    for batch in batches:
        if not batch.num_rows:
            continue
        longs = np.stack([batch.column(p).to_numpy() for p in PARTS], axis=1)
        sig = longs.view(np.uint16)[:, : CHUNKS * WIDTH].reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
        keys = np.empty((len(sig), CHUNKS, WIDTH), np.uint64)
        for c in range(CHUNKS):
            for gap in range(WIDTH):
                h = np.full(len(sig), c * WIDTH + gap + 1, np.uint64)
                for i in range(WIDTH):
                    if i != gap:
                        h = mix64(h * np.uint64(65599) + sig[:, c, i])
                keys[:, c, gap] = h
        ids = np.repeat(batch.column("id").to_numpy(), CHUNKS * WIDTH)
        slots = np.tile(np.arange(CHUNKS * WIDTH, dtype=np.int32), len(sig))
        yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(ids), pa.array(slots)], names=["key", "id", "slot"])


def _similar(shingle: int, percent: int):
    """Keep the pairs whose shingle sets, made of word codes and not of hashes, are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "a_text", 1_000_000):
            n = batch.num_rows
            texts = pa.concat_arrays([batch.column("a_text"), batch.column("b_text")])
            codes, offsets, vocabulary = word_codes(pa.compute.ascii_lower(pa.compute.fill_null(texts, "")))
            code = codes.astype(np.int64) + 1
            sets = [_exact(code[s:e], shingle, len(vocabulary) + 1) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
            keep = []
            for i in range(n):
                x, y = sets[i], sets[n + i]
                shared = len(x & y)
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared) and shared > 0)
            chosen = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column("a").filter(chosen), batch.column("b").filter(chosen)], names=["a", "b"])

    return run


def _exact(code: np.ndarray, shingle: int, base: int) -> set:
    """The shingles of a text as exact keys."""
    if not len(code):
        return set()
    if len(code) < shingle:
        return {tuple(code.tolist())}
    if base**shingle < 2**62:
        key = np.zeros(len(code) - shingle + 1, np.int64)
        for k in range(shingle):
            key = key * base + code[k : len(code) - shingle + 1 + k]
        return set(key.tolist())
    columns = [code[k : len(code) - shingle + 1 + k].tolist() for k in range(shingle)]
    return set(zip(*columns, strict=True))


def confirmed(
    pairs: DataFrame, docs: DataFrame, shingle: int, percent: int, scratch: Scratch, name: str
) -> DataFrame:
    """The pairs (a, b) of class ids that are similar on their full sets."""
    near = scratch.save(pairs.select("a", "b").distinct(), f"{name}_near")
    ids = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = hashed_members(ids, "id")
    texts = docs.filter(wanted(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text")
    # an id that several rows have means the first of their texts
    texts = scratch.save(texts.join(ids, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")), f"{name}_texts")
    a, b = (texts.select(F.col("id").alias(s), F.col("text").alias(f"{s}_text")) for s in "ab")
    both = near.join(b, "b").join(a, "a").select("a", "b", "a_text", "b_text")
    return scratch.save(map_arrow(both, _similar(shingle, percent), "a long, b long"), name)


def side(df: DataFrame, name: str, *more: str) -> DataFrame:
    """The id under a name, with what is known of the class named after it."""
    return df.select(*more, F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ABOUT])


def distance() -> Column:
    """Symbols in which the signatures of a and b differ.

    Every other symbol of a long has room above it: adding all ones carries into that room unless it is zero.
    Few operations, as a long expression would not be compiled.
    """
    ones, carries = F.lit(0x0000FFFF0000FFFF), F.lit(0x0001000000010000)

    def differing(part: str) -> list[Column]:
        x = F.col(f"a_{part}").bitwiseXOR(F.col(f"b_{part}"))
        halves = (x.bitwiseAND(ones), F.shiftrightunsigned(x, 16).bitwiseAND(ones))
        return [F.bit_count((half + ones).bitwiseAND(carries)) for half in halves]

    return reduce(add, [n for part in PARTS for n in differing(part)])


def possible(percent: int) -> Column:
    """Whether sizes and sketches allow a link. The sketches differ in no more bits than the sets in members."""
    low, high, both = F.least("a_n", "b_n"), F.greatest("a_n", "b_n"), F.col("a_n") + F.col("b_n")
    shared = F.floor((both * percent + (99 + percent)) / (100 + percent))  # the least that links, rounded up
    odd = reduce(add, [F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in SKETCH])
    return (low * 100 >= high * percent) & (odd <= both - shared * 2)


def _meet(percent: int):
    """Pairs of a key's members in different components that may be linked, one of them outside the largest.

    Rows come by key and piece, members before those outside; the members of a piece stay while the others pass by.
    Components differ under every key at which two classes meet, so a pair is told under the first of these only.
    """

    def first_slot(same: np.ndarray) -> np.ndarray:
        """The first key at which signatures meet, from the symbols that agree."""
        wrong = ~same.reshape(-1, CHUNKS, WIDTH)
        chunk = (wrong.sum(axis=2) <= 1).argmax(axis=1)
        return chunk * WIDTH + wrong[np.arange(len(wrong)), chunk].argmax(axis=1)

    def pairs(outside: dict, members: dict, slot: int) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // len(members["id"]))
        for start in range(0, len(outside["id"]), step):
            x = {k: v[start : start + step] for k, v in outside.items()}
            both = x["n"][:, None] + members["n"][None]
            low, high = np.minimum(x["n"][:, None], members["n"][None]), np.maximum(x["n"][:, None], members["n"][None])
            ok = (x["component"][:, None] != members["component"][None]) & (low * 100 >= high * percent)
            ok &= members["inside"][None] | (x["id"][:, None] < members["id"][None])
            odd = np.zeros(ok.shape, np.int64)
            for w in range(len(SKETCH)):
                odd += np.bitwise_count(x["sketch"][:, w][:, None] ^ members["sketch"][:, w][None])
            ok &= odd <= both - 2 * -(-both * percent // (100 + percent))
            i, j = np.nonzero(ok)
            same = x["signature"][i] == members["signature"][j]
            different = (~same).sum(axis=1)
            near = (different <= LIMIT) & (first_slot(same) == slot)
            i, j = x["id"][i[near]], members["id"][j[near]]
            columns = [np.maximum(i, j), np.minimum(i, j), different[near].astype(np.int32)]
            yield pa.record_batch([pa.array(c) for c in columns], names=["a", "b", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[dict] = []
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "slot", "piece", "role", "id", "component", "n", "inside")}
            sketch = np.stack([batch.column(c).to_numpy() for c in SKETCH], axis=1).view(np.uint64)  # of signed numbers, bits would be counted without the sign
            longs = np.stack([batch.column(c).to_numpy() for c in PARTS], axis=1)
            about = {c: column[c] for c in ("id", "component", "n", "inside")}
            about |= {"sketch": sketch, "signature": longs.view(np.uint16)[:, : CHUNKS * WIDTH]}
            change = (np.diff(column["key"]) != 0) | (np.diff(column["piece"]) != 0) | (np.diff(column["role"]) != 0)
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                part = {k: v[start:end] for k, v in about.items()}
                place = column["key"][start], column["piece"][start]
                if place != at:
                    at, members = place, []
                if column["role"][start] == 0:
                    members.append(part)
                elif members:
                    members = [{k: np.concatenate([m[k] for m in members]) for k in part}] if len(members) > 1 else members
                    yield from pairs(part, members[0], column["slot"][start])

    return run


class Parts:
    """Components of the classes, as far as links are known."""

    def __init__(self, scratch: Scratch) -> None:
        self.scratch, self.step = scratch, 0
        self.table: DataFrame | None = None  # id, component of the classes on a link

    def of(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """`df` with the component of the id in `column`."""
        if self.table is None:
            return df.withColumn(name, F.col(column))
        own = self.table.select(F.col("id").alias(column), F.col("component").alias(name))
        return df.join(own, column, "left").withColumn(name, F.coalesce(name, column))

    def merge(self, links: DataFrame) -> None:
        """Join the components at the ends of the links (a, b)."""
        if not links.take(1):
            return
        self.step += 1
        ends = self.of(self.of(links.select("a", "b"), "a", "a_part"), "b", "b_part")
        joined = components(ends.select(F.col("a_part").alias("a"), F.col("b_part").alias("b")), self.scratch, f"merge_{self.step}")
        if self.table is not None:
            moved = joined.select(F.col("id").alias("component"), F.col("component").alias("smallest"))
            kept = self.table.join(moved, "component", "left").select("id", F.coalesce("smallest", "component").alias("component"))
            fresh = joined.join(self.table.select("id"), "id", "left_anti")
            joined = kept.unionByName(fresh)
        self.table = self.scratch.save(joined, f"parts_{self.step}")


def minhash_dedup(docs: DataFrame, scratch: Scratch | None = None, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z) and separated by white space; a text with fewer than `shingle` words is
    one shingle. Documents are linked if 100 * intersection >= percent * union; component_id is the
    smallest doc_id that links lead to. Texts without words, and rows without a doc_id, link with nothing
    and are kept; component_id is the doc_id. Rows that repeat a doc_id count under that id with the first
    of their texts. Other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    signed = scratch.save(map_arrow(docs, _sign(shingle), SIGNED), "signed")
    linkable = signed.filter("n_shingles > 0 and doc_id is not null")
    key = ["set_a", "set_b", "n_shingles"]
    classes = scratch.save(
        linkable.groupBy(*key)
        .agg(F.min("doc_id").alias("id"), *[F.first(p).alias(p) for p in SKETCH + PARTS])
        .withColumn("n", F.col("n_shingles")),
        "classes",
    )
    near = possible(percent) & (distance() <= LIMIT)
    index = scratch.save(map_arrow(classes.select("id", *PARTS), _index, "key long, id long, slot int"), "index")
    shared = index.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    index = scratch.save(index.join(shared, "key"), "shared")
    parts = Parts(scratch)

    for r in range(ROUNDS):
        # another member of each key in each round; keys differ, so a class has many pivots to choose from
        pivot = F.min(F.struct(F.xxhash64("key", "id", F.lit(r)).alias("order"), "id"))
        pivots = index.groupBy("key").agg(pivot.alias("p")).select("key", F.col("p.id").alias("b"))
        pairs = index.join(pivots, "key").filter("id != b").select(F.col("id").alias("a"), "b").distinct()
        pairs = parts.of(parts.of(pairs, "a", "a_part"), "b", "b_part").filter("a_part != b_part").select("a", "b")
        hopeful = pairs.join(side(classes, "a"), "a").join(side(classes, "b"), "b").filter(near)
        best = Window.partitionBy("a").orderBy("distance", "b")
        hopeful = hopeful.select("a", "b", distance().alias("distance"))
        hopeful = hopeful.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= TRIES).select("a", "b")
        parts.merge(confirmed(hopeful, docs, shingle, percent, scratch, f"round_{r}"))

    placed = scratch.save(parts.of(index, "id", "component"), "placed")
    sizes = placed.groupBy("key", "members", "component").agg(F.count(F.lit(1)).alias("n"))
    open_keys = (
        sizes.groupBy("key", "members")
        .agg(F.max(F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("parts"))
        .filter("parts > 1")
        .select("key", "members", (F.col("members") - F.col("most.n")).alias("outside"), F.col("most.component").alias("largest"))
    )
    open_keys = scratch.save(open_keys, "open_keys")
    work = open_keys.agg(F.sum(F.col("members").cast("double") * F.col("outside"))).first()[0] or 0.0
    width = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(work / WORK))
    # a key with very many members is met piece by piece; its members come first in a piece, then those outside
    pieces = F.ceil(F.col("members") / PIECE).cast("int")
    spread = placed.drop("members").join(open_keys, "key").join(classes.select("id", *ABOUT), "id")
    spread = spread.select("key", "slot", "id", "component", (F.col("component") == F.col("largest")).alias("inside"), pieces.alias("pieces"), *ABOUT)
    spread = scratch.save(spread, "spread")
    own = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")
    every = spread.withColumns({"piece": own, "role": F.lit(0)})
    few = spread.filter("not inside").withColumns(
        {"piece": F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)), "role": F.lit(1)}
    )
    dealt = every.unionByName(few).drop("pieces").repartition(width, "key", "piece").sortWithinPartitions("key", "piece", "role")
    meet = map_arrow(dealt, _meet(percent), "a long, b long, distance int")
    left = scratch.save(meet.distinct(), "left_0")
    step, tries = 0, 4
    while True:
        open_pairs = parts.of(parts.of(left, "a", "a_part"), "b", "b_part").filter("a_part != b_part")
        two = [F.least("a_part", "b_part"), F.greatest("a_part", "b_part")]
        ranked = open_pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*two).orderBy("distance", "a", "b")))
        ranked = scratch.save(ranked, "ranked")
        if not ranked.take(1):
            break
        parts.merge(confirmed(ranked.filter(F.col("rank") <= tries), docs, shingle, percent, scratch, f"more_{step}"))
        step, left = step + 1, ranked.filter(F.col("rank") > tries).select("a", "b", "distance")
        left, tries = scratch.save(left, f"left_{step % 2 + 1}"), tries * 16

    owner = scratch.save(parts.of(classes.select(*key, "id"), "id", "component").drop("id"), "owner")
    ids = linkable.select("doc_id", *key).join(owner, key)
    alone = signed.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    found = ids.select("doc_id", "n_shingles", "component").unionByName(alone)
    return found.select(
        "doc_id",
        "n_shingles",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"),
    )
