"""Ranked lexical search for many items at once, over a graph of term sets that items share.

The terms that items have in common are mined first: terms that occur in the same items form one set, then the
pair of sets that most items share becomes a set of its own, and so on, until no pair is shared. The sets make a
graph in which each node is the sum of two others, down to single terms. For a group of documents every node is
evaluated once, as a vector of partial scores, whatever the number of items that use it.

Documents are tokenized once for each block of items; a document keeps the terms that some item has. Tasks hand
on the best documents of each item, which are merged in two steps.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from upliftlens.llm.arrays import byte_table, owners, text_bytes, texts_of
from upliftlens.llm.common import Scratch, map_arrow, slices, word_codes

TERMS = byte_table(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", lower=True)
#: Distinct terms of the items in one block, about; it bounds the graph and the vocabulary that tasks hold.
BLOCK_TERMS = 65536
#: Partial scores held at once by a task.
CELLS = 4_000_000
#: An item longer than this shares pairs of its most shared sets only; a longer search would find more to share.
REACH = 256
SATURATED = 1_000_000_000


def term_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Terms as codes: (code of each term, offsets of the rows, the distinct terms)."""
    data, offsets = text_bytes(texts)
    return word_codes(texts_of(TERMS[data], offsets))


@dataclass
class Graph:
    """Nodes are numbered from the leaves up: a leaf is (term, occurrences in the item), another the sum of two."""

    leaves: list[tuple[int, int]] = field(default_factory=list)
    sums: list[tuple[int, int, int]] = field(default_factory=list)
    items: list[int] = field(default_factory=list)  # the node of each item, -1 without terms
    size: int = 0

    def node(self) -> int:
        self.size += 1
        return self.size - 1

    def add(self, parts: list[int]) -> int:
        """The node that sums all parts."""
        while len(parts) > 1:
            sums = []
            for a, b in zip(parts[::2], parts[1::2], strict=False):
                sums.append(self.node())
                self.sums.append((sums[-1], a, b))
            parts = sums + parts[len(parts) // 2 * 2 :]
        return parts[0]


def share(items: list[dict[int, int]]) -> Graph:
    """The graph of a block of items, each given as term -> occurrences."""
    graph = Graph()
    users: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, item in enumerate(items):
        for symbol in sorted(item.items()):
            users[symbol].append(i)
    alike: dict[tuple[int, ...], list[int]] = defaultdict(list)  # terms that the same items have
    for symbol, own in sorted(users.items()):
        alike[tuple(own)].append(graph.node())
        graph.leaves.append(symbol)
    sets: list[set[int]] = [set() for _ in items]
    used: dict[int, set[int]] = {}
    for own, leaves in alike.items():
        node = graph.add(leaves)
        used[node] = set(own)
        for i in own:
            sets[i].add(node)

    pairs: Counter = Counter()
    for own in sets:
        shared = sorted((x for x in own if len(used[x]) > 1), key=lambda x: (-len(used[x]), x))[:REACH]
        pairs.update((min(a, b), max(a, b)) for n, a in enumerate(shared) for b in shared[n + 1 :])
    heap = [(-n, pair) for pair, n in pairs.items() if n > 1]
    heapq.heapify(heap)
    while heap:
        n, (a, b) = heapq.heappop(heap)
        both = used[a] & used[b]
        if len(both) < 2:
            continue
        if -n != len(both):  # some of these items have been merged meanwhile
            heapq.heappush(heap, (-len(both), (a, b)))
            continue
        node = graph.add([a, b])
        used[node] = both
        used[a], used[b] = used[a] - both, used[b] - both
        near: Counter = Counter()
        for i in both:
            sets[i] -= {a, b}
            near.update(x for x in sets[i] if len(used[x]) > 1)
            sets[i].add(node)
        for other, n in near.items():
            if n > 1:
                heapq.heappush(heap, (-n, (other, node)))
    graph.items = [graph.add(sorted(own)) if own else -1 for own in sets]
    return graph


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of each item with their numbers of occurrences."""
    for batch in slices(batches):
        codes, offsets, vocabulary = term_codes(batch.column("text"))
        terms, counts = [], []
        for start, end in zip(offsets[:-1], offsets[1:], strict=True):
            own, n = np.unique(codes[start:end], return_counts=True)
            terms.append(vocabulary.take(pa.array(own)).to_pylist())
            counts.append(n)
        columns = [pa.array(terms, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))]
        yield pa.record_batch([batch.column("row"), batch.column("item_id"), *columns], names=["row", "item_id", "terms", "counts"])


def _postings(vocabulary: list[str]):
    """For documents with a term: their length, and the items' terms in them with their occurrences."""
    known = pa.array(vocabulary, pa.large_string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes, offsets, words = term_codes(batch.column("text"))
            place = pc.index_in(words, known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            lengths = np.diff(offsets)
            term = place[codes] if len(codes) else np.zeros(0, np.int64)
            row, term = owners(offsets)[term >= 0], term[term >= 0]
            keys, tf = np.unique(row * len(vocabulary) + term, return_counts=True)
            ends = np.searchsorted(keys, np.arange(batch.num_rows + 1) * len(vocabulary)).astype(np.int32)
            ends = pa.array(ends)
            columns = [
                batch.column("doc_id"),
                pa.array(lengths),
                pa.ListArray.from_arrays(ends, pa.array((keys % max(1, len(vocabulary))).astype(np.int32))),
                pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int64))),
            ]
            out = pa.record_batch(columns, names=["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(lengths > 0))

    return run


@dataclass
class Ranking:
    """What tasks need to score documents: the graph, the terms' weights, N and L of the corpus."""

    graph: Graph
    weights: np.ndarray
    n: int
    length: int
    best: int

    def impacts(self, lengths: np.ndarray, rows: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        """The score that a term gives a document, of one occurrence in an item."""
        if len(lengths) and 25 * int(lengths.max()) * self.n >= 1 << 63:
            ratio = np.array([25 * int(x) * self.n // self.length for x in lengths], np.int64)
        else:
            ratio = 25 * lengths * self.n // self.length
        m = 100 - 25 + ratio
        return self.weights[terms] * ((SATURATED * tfs) // (1000 * tfs + 12 * m[rows]))

    def scores(self, n_docs: int, rows: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> np.ndarray:
        """Scores by item and document. A node is evaluated once and goes after its last use."""
        order = np.argsort(terms, kind="stable")
        rows, terms, impacts = rows[order], terms[order], impacts[order]
        begins = np.searchsorted(terms, np.arange(len(self.weights) + 1))
        values: dict[int, np.ndarray] = {}
        uses = Counter(x for _, a, b in self.graph.sums for x in (a, b)) + Counter(x for x in self.graph.items if x >= 0)

        def value(node: int) -> np.ndarray:
            if node < len(self.graph.leaves) and node not in values:
                term, times = self.graph.leaves[node]
                own = slice(begins[term], begins[term + 1])
                values[node] = np.zeros(n_docs, np.int64)
                values[node][rows[own]] = impacts[own] * times
            uses[node] -= 1
            return values[node] if uses[node] else values.pop(node)

        out = np.zeros((len(self.graph.items), n_docs), np.int64)
        for node, a, b in self.graph.sums:
            values[node] = value(a) + value(b)
        for i, node in enumerate(self.graph.items):
            if node >= 0:
                out[i] = value(node)
        return out


def _best(ranking: Ranking):
    """The best documents of each item among those of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_items, best = len(ranking.graph.items), ranking.best
        group = max(64, CELLS // max(1, ranking.graph.size + n_items))
        kept = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, id, whether the id is NULL
        least = np.zeros(n_items, np.int64)  # a lower score than this is not among the best
        waiting: list[list[np.ndarray]] = []

        def reduce() -> None:
            nonlocal kept
            item, score, ids, unknown = kept = [np.concatenate(x) for x in zip(kept, *waiting, strict=True)]
            waiting.clear()
            order = np.lexsort((ids, unknown, -score, item))
            first = np.searchsorted(item[order], item[order])
            order = order[np.arange(len(order)) - first < best]
            kept = [x[order] for x in kept]
            count = np.bincount(kept[0], minlength=n_items)
            last = np.cumsum(count) - 1
            least[count == best] = kept[1][last[count == best]]

        for batch in batches:
            for start in range(0, batch.num_rows, group):
                part = batch.slice(start, group)
                offsets = np.asarray(part.column("terms").offsets, np.int64)
                rows = owners(offsets)
                terms = part.column("terms").flatten().to_numpy(zero_copy_only=False)
                tfs = part.column("tfs").flatten().to_numpy(zero_copy_only=False)
                lengths = part.column("n").to_numpy(zero_copy_only=False)
                scores = ranking.scores(part.num_rows, rows, terms, ranking.impacts(lengths, rows, terms, tfs))
                item, row = np.nonzero(scores >= np.maximum(least, 1)[:, None])
                ids = pc.fill_null(part.column("doc_id"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                unknown = part.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                waiting.append([item, scores[item, row], ids[row], unknown[row]])
                if sum(len(x[0]) for x in waiting) > 8 * n_items * best:
                    reduce()
        if waiting:
            reduce()
        ids = pa.array(kept[2], mask=kept[3].astype(bool))
        yield pa.record_batch([pa.array(kept[0].astype(np.int32)), ids, pa.array(kept[1])], names=["place", "doc_id", "score"])

    return run


def _first(found: DataFrame, best: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


def lexical_search(
    docs: DataFrame, items: DataFrame, scratch: Scratch | None = None, best: int = 20, block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """(doc_id, text) and (item_id, text) -> item_id, rank, doc_id, score: the best documents of each item.

    A score is the sum over an item's terms, repeats included, of a saturated frequency times a rarity, in whole
    numbers; see `Ranking.impacts`. Only scores above 0 rank; equal ones go by doc_id, NULL last. Each row of
    `items` is an item and each row of `docs` a document, also if it repeats an id. NULL and empty texts have no
    terms: such items get no rows, such documents count nowhere. Empty tables give no rows. Other columns are
    ignored. Items are taken in blocks of about `block_terms` distinct terms, by hash, one pass over the
    documents for each; the driver holds the items of one block.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    item_id = items.schema["item_id"].dataType.simpleString()
    rows = items.select(F.monotonically_increasing_id().alias("row"), "item_id", "text")
    rows = map_arrow(rows, _tokens, f"row long, item_id {item_id}, terms array<string>, counts array<long>")
    rows = scratch.save(rows.filter(F.size("terms") > 0), "items")
    blocks = -(-(rows.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms)
    block = F.pmod(F.xxhash64("row"), F.lit(max(1, blocks)))
    results = [_search_block(docs, rows.filter(block == b), scratch, best, b) for b in range(max(1, blocks))]
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def _search_block(docs: DataFrame, items: DataFrame, scratch: Scratch, best: int, block: int) -> DataFrame:
    spark = docs.sparkSession
    own = sorted(items.collect(), key=lambda r: r.row)  # about `block_terms` terms
    vocabulary = sorted({t for r in own for t in r.terms})
    place = {t: i for i, t in enumerate(vocabulary)}
    graph = share([{place[t]: n for t, n in zip(r.terms, r.counts, strict=True)} for r in own])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    postings = map_arrow(texts, _postings(vocabulary), "doc_id long, n long, terms array<int>, tfs array<long>")
    postings = scratch.save(postings, f"postings_{block}")
    n, length = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    counted = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = np.zeros(len(vocabulary), np.int64)
    for r in counted.collect():  # a row for each term of the block at most
        df[r.term] = r.df
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    ranking = Ranking(graph, weights, n, max(1, length), best)
    found = map_arrow(postings, _best(ranking), "place int, doc_id long, score long")
    found = found.withColumn("task", F.pmod(F.spark_partition_id(), F.lit(64)))
    found = scratch.save(_first(found, best, "place", "task").drop("rank"), f"found_{block}")
    names = items.select("row", "item_id").join(
        spark.createDataFrame([(r.row, i) for i, r in enumerate(own)], "row long, place int"), "row"
    )
    ranked = scratch.save(_first(found, best, "place"), f"ranked_{block}")
    return ranked.join(names, "place").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
