"""Ranked lexical search of all items over all documents, by dual trees.

A term's weight in an item and its value in a document are whole numbers, a score is the
sum of their products, so sums in doubles are exact as long as they stay below 2^53.
Documents of a chunk are ordered by their weightiest terms and grouped into a hierarchy,
and so are the items; a node holds the largest coordinate of its members for every term.
The product of two nodes bounds every score below the pair. A pair is given up, with all
documents and items below it, if its bound is under the weakest kth score among its items,
or zero; otherwise the higher of the two nodes is opened, until single documents meet single
items and the product is the score. Thresholds start at the kth scores over a hash share of
the documents, which can only be too low, and rise within a task. Nothing else depends on them.

Texts are read once per block of items, to count the terms of that block; ranking reads
these counts. Items are dealt by hash into blocks of about ``BLOCK_ITEMS`` items and
``BLOCK_TERMS`` terms, counted first, and only one block is broadcast at a time. Each
chunk hands on at most k documents per item, which Spark ranks.

Defined results. Null, empty and term-less texts are not documents of the collection, and
items without a term of any document get no row. Rows that repeat an item id are one item
with all their terms, a null id included. Rows that repeat a document id are documents of
their own. Equal scores go by ascending id, null last. Fewer than k positive scores give
fewer rows. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.operators.work import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Maximal runs of ASCII letters, digits and non-ASCII characters, over UTF-8 bytes.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
BLOCK_ITEMS, BLOCK_TERMS = 400, 16_000
PIECE_BYTES = 1 << 20
#: Cells of a chunk's dense matrix of documents and terms.
CHUNK_CELLS, CHUNK_DOCS = 1 << 20, 4096
FAN = 8
#: Documents that set the first thresholds.
SEED_DOCS = 20_000


def pieces(text: bytes, limit: int = PIECE_BYTES):
    """The text in parts of about ``limit`` bytes that end where no term goes on."""
    at = 0
    while len(text) - at > limit:
        gap = GAP.search(text, at + limit)
        if gap is None:
            break
        yield text[at : gap.end()]
        at = gap.end()
    yield text[at:] if at else text


def term_counts(text: bytes, known) -> tuple[int, dict[bytes, int]]:
    """Number of terms of a text, and the counts of the known ones; A-Z count as a-z."""
    n, found = 0, {}
    for piece in pieces(text):
        terms = TERM.findall(piece.lower())
        n += len(terms)
        counts = Counter(terms)
        for term in counts.keys() & known:
            found[term] = found.get(term, 0) + counts[term]
    return n, found


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term): the distinct terms of every item."""
    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("binary").alias("text")).where("text IS NOT NULL")
    kind = rows.schema["item"].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            at, terms = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                own = {t for piece in pieces(text) for t in TERM.findall(piece.lower())}
                at += [k] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(at, pa.int64())), pa.array(terms, pa.binary())], ["item", "term"])

    return rows.mapInArrow(scan, f"item {kind}, term binary").distinct()


def _count(shared):
    """Task function: (id, n, terms, tf) of every document, over the broadcast terms."""

    def scan(batches):
        known = shared.value
        for batch in batches:
            sizes, terms, tf = [], [], []
            for text in batch.column("text"):
                n, found = term_counts(text.as_py() or b"", known.keys())
                sizes.append(n)
                terms.append([known[t] for t in found])
                tf.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], ["id", "n", "terms", "tf"])

    return scan


def _levels(rows: np.ndarray) -> list[np.ndarray]:
    """The rows, then coordinate maxima of every FAN rows, and so on up to one row."""
    out = [rows]
    while len(out[-1]) > 1:
        out.append(np.maximum.reduceat(out[-1], np.arange(0, len(out[-1]), FAN), axis=0))
    return out


class ItemTree:
    """Items in order of their weightiest terms, and the coordinate maxima above them."""

    def __init__(self, items: list[list[int]], weight: np.ndarray, dtype):
        rank = [sorted(((-int(weight[t]), t) for t in terms))[:3] for terms in items]
        self.order = sorted(range(len(items)), key=lambda i: rank[i])
        rows = np.zeros((len(items), len(weight)), dtype)
        for row, i in enumerate(self.order):
            rows[row, items[i]] = weight[items[i]]
        self.levels = _levels(rows)
        self.support = [[np.flatnonzero(r) for r in level] for level in self.levels]


def search_chunk(tree: ItemTree, values: np.ndarray, kth: np.ndarray, scores_of) -> None:
    """Meet the item tree with the hierarchy over ``values`` (documents x terms).

    ``kth`` holds the items' weakest scores in tree order and may rise meanwhile.
    ``scores_of(item, documents, scores)`` takes what is found, every document of an item at
    least as good as its weakest score at that time.
    """
    docs = _levels(values)

    def floor_of(level: int, node: int) -> float:
        return max(1, kth[node * FAN**level : (node + 1) * FAN**level].min())

    def bounds(level: int, node: int, doc_level: int, doc_nodes: np.ndarray) -> np.ndarray:
        use = tree.support[level][node]
        return docs[doc_level][np.ix_(doc_nodes, use)] @ tree.levels[level][node, use]

    first = (len(tree.levels) - 1, 0, len(docs) - 1, np.zeros(1, np.int64))
    todo = [first]
    while todo:
        level, node, doc_level, nodes = todo.pop()
        bound = bounds(level, node, doc_level, nodes)
        keep = bound >= floor_of(level, node)
        if not keep.any():
            continue
        nodes = nodes[keep]
        if level == doc_level == 0:
            scores_of(node, nodes, bound[keep])
        elif doc_level and doc_level >= level:
            below = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
            todo.append((level, node, doc_level - 1, below[below < len(docs[doc_level - 1])]))
        else:
            last = min((node + 1) * FAN, len(tree.levels[level - 1]))
            todo += [(level - 1, child, doc_level, nodes) for child in range(node * FAN, last)]


def _rank_docs(score: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best, by descending score, then ascending order."""
    return np.lexsort((order, -score))[:k]


def _search(shared, id_type: str, k: int):
    """Task function: candidates (item, id, score), at most k per item and chunk."""

    def scan(batches):
        held = shared.value
        items, weight, n_docs, n_terms, floor = (held[x] for x in ("items", "weight", "n_docs", "n_terms", "floor"))
        dtype = np.float64 if len(weight) * 10**6 * int(max(weight.max(initial=1), 1)) < 2**53 else np.int64
        tree = ItemTree(items, weight, dtype)
        kth = floor[tree.order].astype(np.int64)
        best = [np.zeros(0, np.int64) for _ in items]
        rows = max(FAN, min(CHUNK_DOCS, CHUNK_CELLS // max(1, len(weight))))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                lists, tfs = part.column("terms"), part.column("tf")
                lengths = np.asarray(pc.list_value_length(lists))
                doc = np.repeat(np.arange(part.num_rows), lengths)
                term, tf = lists.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy()
                m = np.array([10 + 90 * n * n_docs // n_terms for n in part.column("n").to_pylist()], np.int64)
                value = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
                # documents next to each other share their weightiest term
                by = np.lexsort((value * weight[term], doc))
                last = np.cumsum(lengths) - 1
                lead, second = term[by][last], term[by][np.maximum(last - 1, np.cumsum(lengths) - lengths)]
                order = np.lexsort((second, lead))
                place = np.empty(part.num_rows, np.int64)
                place[order] = np.arange(part.num_rows)
                dense = np.zeros((part.num_rows, len(weight)), dtype)
                dense[place[doc], term] = value
                by_id = np.asarray(pc.rank(part.column("id"), sort_keys="ascending", null_placement="at_end", tiebreaker="dense")).astype(np.int64)[order]
                found: dict[int, list] = {}

                def scores_of(item, docs, scores):
                    found.setdefault(item, []).append((docs, scores))
                    best[item] = np.sort(np.r_[best[item], scores.astype(np.int64)])[-k:]
                    if len(best[item]) == k:
                        kth[item] = max(kth[item], best[item][0])

                search_chunk(tree, dense, kth, scores_of)
                names, docs, scores = [], [], []
                for item, parts in found.items():
                    own, score = (np.concatenate(x) for x in zip(*parts))
                    use = _rank_docs(score, by_id[own], k)
                    use = use[score[use] >= kth[item]]
                    names += [tree.order[item]] * len(use)
                    docs.append(order[own[use]])
                    scores.append(score[use].astype(np.int64))
                if names:
                    ids = part.column("id").take(pa.array(np.concatenate(docs)))
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), ids, pa.array(np.concatenate(scores), pa.int64())], ["item", "id", "score"])

    return scan, f"item int, id {id_type}, score long"


def _top(candidates: DataFrame, k: int) -> DataFrame:
    ranked = candidates.withColumn("rank", F.expr("row_number() OVER (PARTITION BY item ORDER BY score DESC, id ASC NULLS LAST)"))
    return ranked.where(F.col("rank") <= k)


def _search_block(counts: DataFrame, items: list[list[int]], df: np.ndarray, n_docs: int, n_terms: int, k: int, seed_docs: int) -> DataFrame:
    """(item, id, score, rank) for the items of one block."""
    context = counts.sparkSession.sparkContext
    weight = np.array([int(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    held = {"items": items, "weight": weight, "n_docs": n_docs, "n_terms": n_terms, "floor": np.zeros(len(items), np.int64)}
    rows, kind = counts.where(F.size("terms") > 0), counts.schema["id"].dataType.simpleString()
    if n_docs > 2 * seed_docs:
        share = -(-n_docs // seed_docs)
        few = rows.where(F.pmod(F.xxhash64("id", "n", F.lit(7)), F.lit(share)) == 0)
        first = _top(few.mapInArrow(*_search(context.broadcast(held), kind, k)), k)
        for r in first.groupBy("item").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).collect():
            held["floor"][r["item"]] = r["least"]
    return _top(rows.mapInArrow(*_search(context.broadcast(held), kind, k)), k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS, seed_docs: int = SEED_DOCS) -> DataFrame:
    """(item_id, rank, id, score): the k best documents of every item.

    A score sums, over the item's terms, weight * value; with N documents, L terms of all
    documents, a document of n terms, a term in df documents and tf times in this one, weight
    is floor(1000 ln((2 N + 2) / (2 df + 1))), value is 10^9 tf div (1000 tf + 8 m), and
    m is 10 + 90 n N div L.
    """
    spark = docs.sparkSession
    terms = settle(item_terms(items, item_col, item_text_col))
    size = terms.agg(F.count("*").alias("terms"), F.countDistinct(F.struct("item")).alias("items")).first()
    blocks = max(1, -(-size["items"] // block_items), -(-size["terms"] // block_terms))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    id_kind, item_kind = rows.schema["id"].dataType.simpleString(), terms.schema["item"].dataType
    results = []
    for block in range(blocks):
        own: dict = {}
        for r in terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect():
            own.setdefault(r["item"], []).append(bytes(r["term"]))
        names = sorted(own, key=lambda x: (x is None, x))
        known = {t: i for i, t in enumerate(sorted({t for ts in own.values() for t in ts}))}
        counts = rows.mapInArrow(_count(spark.sparkContext.broadcast(known)), f"id {id_kind}, n long, terms array<int>, tf array<long>")
        counts = settle(counts)
        sums = counts.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
        df = np.zeros(len(known), np.int64)
        for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
            df[r["t"]] = r["df"]
        found = _search_block(counts, [sorted(known[t] for t in own[x]) for x in names], df, sums["docs"], sums["terms"] or 0, k, seed_docs)
        table = spark.createDataFrame([(i, x) for i, x in enumerate(names)], f"item int, item_id {item_kind.simpleString()}")
        results.append(found.join(F.broadcast(table), "item").select("item_id", "rank", "id", "score"))
    return reduce(DataFrame.unionByName, results)
