"""Toxicity: a learned lexicon, found through Levenshtein automata, weighed in context.

The lexicon holds words and stems (beginnings of words) that mark labelled toxic
documents, by the lower bound of their log odds. Its words form a trie. Walking the trie
and a Levenshtein automaton together gives, for every character, the set of trie nodes
within reach and their least number of edits; these sets are the states of one
deterministic automaton, made when first met. All words of a batch step through it at
once, so a misspelled term costs a table look-up a character. Words allow edits by their
length (``edits_allowed``), stems none.

Every match is weighed where it stands: whether it lies between quotation marks of its line,
and how much the six words on either side speak for abuse or for mere mention, both learned.
A surface that labelled clean documents use themselves (an ordinary word one edit from a
term) takes its own odds instead of the term's. A logistic model over a document's sums makes
the score.

The fit uses at most ``sample_rows`` labelled documents outside the held-out fold, those of
smallest id hash, one of each group of copies; two thirds make the lexicon, one third
the model. Lexicon, context weights and model have a fixed size. Documents are scored in one
map over the table; a long text goes piece by piece, with margins as wide as a context.

Defined results. Null and empty texts have no word and get the score of a document without
matches. Rows repeating an id are scored each; a document labelled more than once takes its
highest label. A null id is never held out nor learned from. With labels of one kind only
the score is their share, with none 0.5. Extra columns are not read.
"""

from __future__ import annotations

import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.operators.work import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_ROWS, SAMPLE_PARTS = 8000, 16
LEXICON, LEAST_DOCS, LEAST_ODDS = 96, 3, 1.0
STEMS = range(4, 9)
LONGEST = 32
SURFACES = 4096
SLOTS, REACH, CONTEXT_CHARS = 4096, 6, 1000
PIECE, MARGIN, CHUNK = 1 << 18, 1024, 1 << 20
THRESHOLD = 0.7
INPUTS = 9

#: Characters below LIMIT: their lower-case form, and whether they belong to words.
LIMIT = 0x3000
LOWER = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in map(chr, range(LIMIT))], np.uint32)
LETTER = np.array([c.isalnum() for c in map(chr, range(LIMIT))])
#: Marks that stand for a letter when they have letters on both sides.
MASKS = np.array([ord(c) for c in "*@$"], np.uint32)
QUOTES = np.array([ord(c) for c in '"“”„«»'], np.uint32)


def held_out(id_col: Column) -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def edits_allowed(word: str) -> int:
    return 0 if len(word) < 5 else 1 if len(word) < 9 else 2


class Automaton:
    """All words within an entry's edits, and all words that begin with a stem.

    ``entries`` holds (text, is_stem). A state is a set of (trie node, least edits), 0 the
    empty one. ``table`` holds the next state by state and character class, -1 if not made yet.
    """

    def __init__(self, entries):
        self.children, self.word, self.stem, self.allowed = [{}], [-1], [-1], [0]
        self.alphabet = np.array(sorted({ord(c) for text, _ in entries for c in text}), np.uint32)
        for k, (text, is_stem) in enumerate(entries):
            node, edits = 0, 0 if is_stem else edits_allowed(text)
            path = [0]
            for c in text:
                if (code := int(np.searchsorted(self.alphabet, ord(c))) + 1) not in self.children[node]:
                    self.children[node][code] = len(self.children)
                    for held, empty in ((self.children, {}), (self.word, -1), (self.stem, -1), (self.allowed, 0)):
                        held.append(empty)
                node = self.children[node][code]
                path.append(node)
            (self.stem if is_stem else self.word)[node] = k
            for at in path:
                self.allowed[at] = max(self.allowed[at], edits)
        self.edits = [0 if is_stem else edits_allowed(text) for text, is_stem in entries]
        self.sets, self.number = [frozenset()], {frozenset(): 0}
        self.table = np.zeros((1, len(self.alphabet) + 1), np.int32)
        self.found = np.full((1, 3), -1, np.int32)  # stem, word, edits of the word
        self.start = self._state({0: 0})

    def classes(self, codes: np.ndarray) -> np.ndarray:
        """Character classes from 1; 0 for characters of no entry."""
        if not len(self.alphabet):
            return np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at + 1, 0)

    def _state(self, reached: dict[int, int]) -> int:
        todo = list(reached)
        while todo:  # a letter of the term that the word leaves out
            node = todo.pop()
            more = reached[node] + 1
            for child in self.children[node].values():
                if more <= self.allowed[child] and more < reached.get(child, 9):
                    reached[child] = more
                    todo.append(child)
        key = frozenset(reached.items())
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            stem = next((self.stem[n] for n, e in sorted(key) if e == 0 and self.stem[n] >= 0), -1)
            least = min(((e, self.word[n]) for n, e in key if self.word[n] >= 0 and e <= self.edits[self.word[n]]), default=(-1, -1))
            if len(self.sets) > len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.found = np.concatenate([self.found, np.full_like(self.found, -1)])
            self.table[self.number[key]] = -1
            self.found[self.number[key]] = stem, least[1], least[0]
        return self.number[key]

    def _step(self, state: int, code: int) -> int:
        reached: dict[int, int] = {}

        def add(node: int, edits: int) -> None:
            if edits <= self.allowed[node] and edits < reached.get(node, 9):
                reached[node] = edits

        for node, edits in self.sets[state]:
            for letter, child in self.children[node].items():
                add(child, edits + (letter != code))
            add(node, edits + 1)
        return self._state(reached)

    def match(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Entry (-1: none), and edits, of every word."""
        entry, edits = np.full(len(starts), -1), np.zeros(len(starts), np.int64)
        at, state, step = np.arange(len(starts)), np.full(len(starts), self.start), 0
        while len(at):
            code = codes[starts[at] + step]
            new = self.table[state, code]
            for pair in np.unique(state[new < 0] * self.table.shape[1] + code[new < 0]).tolist():
                before, letter = divmod(pair, self.table.shape[1])
                after = self._step(before, letter)
                self.table[before, letter] = after
            state = self.table[state, code]
            step += 1
            stem = self.found[state, 0]
            fresh = (stem >= 0) & (entry[at] < 0)
            entry[at[fresh]] = stem[fresh]
            over = (lengths[at] == step) & (self.found[state, 1] >= 0)
            over &= (self.found[state, 2] == 0) | (entry[at] < 0)
            entry[at[over]], edits[at[over]] = self.found[state[over], 1], self.found[state[over], 2]
            on = (state != 0) & (lengths[at] > step)
            at, state = at[on], state[on]
        return entry, edits


def text_pieces(texts):
    """(row, first, last, from, characters): parts of the texts with their margins."""
    for row, text in enumerate(texts):
        text = text or ""
        for at in range(0, max(len(text), 1), PIECE):
            low, last = max(0, at - MARGIN), min(len(text), at + PIECE)
            yield row, at, last, low, text[low : last + MARGIN]


def chunks(texts):
    """The pieces in lists of about CHUNK characters."""
    held, size = [], 0
    for piece in text_pieces(texts):
        held.append(piece)
        size += len(piece[4])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


class Words:
    """The words of the pieces of one chunk: bounds in code points, and whose they are."""

    def __init__(self, pieces):
        raw = "\n".join(p[4] for p in pieces)
        # a lone surrogate cannot be encoded; it stands for no letter
        self.raw = np.frombuffer(raw.encode("utf-32-le", "replace"), np.uint32)
        small = np.minimum(self.raw, LIMIT - 1)
        self.codes = np.where(self.raw < LIMIT, LOWER[small], self.raw)
        letter = np.where(self.raw < LIMIT, LETTER[small], True)
        mask = np.isin(self.raw, MASKS)
        mask[1:] &= letter[:-1]
        mask[:-1] &= letter[1:]
        edge = np.diff(np.r_[False, letter | mask, False].astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.sizes = self.ends - self.starts
        bounds = np.cumsum([0, *(len(p[4]) + 1 for p in pieces)])
        self.piece = np.searchsorted(bounds, self.starts, "right") - 1
        rows, firsts, lasts, lows = (np.array([p[i] for p in pieces], np.int64) for i in range(4))
        self.row = rows[self.piece]
        self.place = self.starts - bounds[self.piece] + lows[self.piece]
        self.own = (self.place >= firsts[self.piece]) & (self.place < lasts[self.piece])
        self.bounds = bounds

    def surface(self, word: int) -> str:
        return self.codes[self.starts[word] : self.ends[word]].astype("<u4").tobytes().decode("utf-32-le", "replace")

    def slots(self, at: np.ndarray) -> np.ndarray:
        """Context slot of words, by their first twelve characters."""
        value = np.zeros(len(at), np.uint64)
        for j in range(12):
            more = self.sizes[at] > j
            value = np.where(more, value * np.uint64(1_000_003) + self.codes[np.minimum(self.starts[at] + j, len(self.codes) - 1)], value)
        value ^= value >> np.uint64(29)
        return (value * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)).astype(np.int64)

    def context(self, hits: np.ndarray) -> np.ndarray:
        """Slots of the words around each hit; -1 where there is none."""
        steps = np.r_[-REACH:0, 1 : REACH + 1]
        near = hits[:, None] + steps
        inside = (near >= 0) & (near < len(self.starts))
        near = np.clip(near, 0, len(self.starts) - 1)
        inside &= (self.piece[near] == self.piece[hits][:, None]) & (np.abs(self.starts[near] - self.starts[hits][:, None]) <= CONTEXT_CHARS)
        return np.where(inside, self.slots(near.ravel()).reshape(near.shape), -1)

    def quoted(self, hits: np.ndarray) -> np.ndarray:
        """Whether an odd number of quotation marks stands before the hit in its line and one after."""
        marks, breaks = np.flatnonzero(np.isin(self.raw, QUOTES)), np.flatnonzero(self.raw == 10)
        breaks = np.union1d(np.r_[-1, breaks, len(self.raw)], self.bounds[1:-1] - 1)
        at = np.searchsorted(breaks, self.starts[hits])
        first = np.maximum(breaks[at - 1] + 1, self.starts[hits] - CONTEXT_CHARS)
        last = np.minimum(breaks[at], self.starts[hits] + CONTEXT_CHARS)
        here = np.searchsorted(marks, self.starts[hits])
        return ((here - np.searchsorted(marks, first)) % 2 == 1) & (np.searchsorted(marks, last) > here)


def vocabulary_counts(texts, toxic) -> Counter:
    """(term, is_stem, toxic) -> documents, of the words and stems of whole texts."""
    counts: Counter = Counter()
    for text, y in zip(texts, toxic):
        seen = set()
        for pieces in chunks([text]):
            words = Words(pieces)
            for k in np.flatnonzero(words.own & (words.sizes <= LONGEST)).tolist():
                word = words.surface(k)
                seen.add((word, False))
                seen.update((word[:n], True) for n in STEMS if n < len(word))
        counts.update((term, is_stem, y) for term, is_stem in seen)
    return counts


def choose_entries(rows, size: int = LEXICON):
    """(text, is_stem, weight) of the best terms; ``rows`` has term, is_stem, toxic documents, bound.

    A stem under a chosen stem adds nothing, nor does one that is hardly more frequent than a
    chosen word under it. Words under a stem stay, as only words are found misspelled.
    """
    chosen = []
    for term, is_stem, a, bound in sorted(rows, key=lambda r: (-r[3], r[1], r[0])):
        stems = [t for t, s, *_ in chosen if s]
        if is_stem and (any(term.startswith(t) for t in stems) or any(not s and t.startswith(term) and a <= 1.1 * n for t, s, n, _ in chosen)):
            continue
        chosen.append((term, is_stem, a, float(bound)))
        if len(chosen) == size:
            break
    return [(t, s, w) for t, s, _, w in chosen]


def find_hits(automaton: Automaton, pieces):
    """The words of a chunk, and number, entry and edits of those that match."""
    words = Words(pieces)
    entry, edits = automaton.match(automaton.classes(words.codes), words.starts, words.sizes)
    hits = np.flatnonzero((entry >= 0) & words.own)
    return words, hits, entry[hits], edits[hits]


def features(held: dict, automaton: Automaton, texts) -> np.ndarray:
    """One row per text: sums over its matches by kind, best match, context, spread, length."""
    sums = np.zeros((len(texts), 8))
    best, seen = np.zeros(len(texts)), [set() for _ in texts]
    weight, is_stem = held["weight"], held["is_stem"]
    for pieces in chunks(texts):
        words, hits, entry, edits = find_hits(automaton, pieces)
        sums[:, 7] += np.bincount(words.row[words.own], minlength=len(texts))
        if not len(hits):
            continue
        value = weight[entry] * np.where(edits > 0, 0.6, 1.0)
        for k in np.flatnonzero(edits > 0).tolist():
            value[k] = min(value[k], held["surfaces"].get(words.surface(hits[k]), value[k]))
        slots = words.context(hits)
        context = np.where(slots >= 0, held["context"][slots], 0).sum(1) / np.maximum((slots >= 0).sum(1), 1) ** 0.5
        quoted, row = words.quoted(hits), words.row[hits]
        kind = np.where(quoted, 3, np.where(is_stem[entry], 2, np.where(edits > 0, 1, 0)))
        np.add.at(sums, (row, kind), value)
        np.add.at(sums, (row, 4), np.where(quoted, 0, context))
        np.add.at(sums, (row, 5), value > 0)
        np.maximum.at(best, row, np.where(quoted, 0, value + context))
        for r, e, v in zip(row.tolist(), entry.tolist(), value.tolist()):
            if v > 0:
                seen[r].add(e)
    found, size = sums[:, 5], sums[:, 7]
    return np.column_stack([
        np.log1p(sums[:, :4]), best, sums[:, 4] / np.maximum(found, 1), np.log1p(100 * found / np.maximum(size, 1)),
        np.log1p([len(s) for s in seen]), np.log1p(size),
    ])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
    """(centre, scale, weights, bias) by Newton steps."""
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    beta, hold = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(hold + 1e-9), z.T @ (y - p) - hold * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, beta[:-1], float(beta[-1])


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int) -> DataFrame:
    """(text, y, model): labelled documents, one of each group of copies; ``model`` marks the third for the model."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    known = settle(known.orderBy(F.xxhash64("id"), "id").limit(sample_rows))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    # the smallest hash of three successive words: copies mostly share it
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+")
    smallest = F.expr("array_min(transform(sequence(0, greatest(size(w) - 3, 0)), i -> xxhash64(slice(w, i + 1, 3))))")
    rows = settle(rows.withColumn("w", words).withColumn("copy", smallest).drop("w"))
    first = rows.withColumn("n", F.expr("row_number() OVER (PARTITION BY copy ORDER BY id, text)")).where("n = 1")
    return settle(first.repartition(SAMPLE_PARTS, "id").select("text", "y", (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(3)) == 0).alias("model")))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> dict:
    """Learn lexicon, context and model; a dict of plain arrays and dicts, fit to be broadcast."""
    sample = _sample(docs, labels, id_col, text_col, label_col, sample_rows)
    context = docs.sparkSession.sparkContext
    counts = {(r["model"], r["y"]): r["n"] for r in sample.groupBy("model", "y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = counts.get((False, 0), 0), counts.get((False, 1), 0)

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            total += vocabulary_counts(batch.column("text").to_pylist(), batch.column("y").to_pylist())
        rows = [(t, s, n * y, n * (1 - y)) for (t, s, y), n in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.bool_(), pa.int64(), pa.int64()))], ["term", "is_stem", "a", "b"])

    learn = sample.where("NOT model").select("text", "y")
    terms = learn.mapInArrow(count, "term string, is_stem boolean, a long, b long").groupBy("term", "is_stem").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    bound = F.expr(f"ln((a + 0.5) / ({n1} - a + 0.5)) - ln((b + 0.5) / ({n0} - b + 0.5)) - 2 * sqrt(1 / (a + 0.5) + 1 / (b + 0.5))")
    terms = terms.where(F.col("a") >= LEAST_DOCS).withColumn("bound", bound).where(F.col("bound") > LEAST_ODDS)
    best = terms.orderBy(F.desc("bound"), "is_stem", "term").limit(40 * LEXICON)
    entries = choose_entries([(r["term"], r["is_stem"], r["a"], r["bound"]) for r in best.collect()])
    held = {
        "entries": [(t, s) for t, s, _ in entries], "weight": np.array([w for *_, w in entries], float), "is_stem": np.array([s for _, s, _ in entries], bool),
        "surfaces": {}, "context": np.zeros(SLOTS),
    }
    shared = context.broadcast(held["entries"])

    def meet(batches):
        """Surfaces of edited matches, and context slots, with the documents that have them."""
        automaton, total = Automaton(shared.value), Counter()
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                own = set()
                for pieces in chunks([text]):
                    words, hits, _, edits = find_hits(automaton, pieces)
                    if len(hits):
                        own.add(("", -1))
                        own.update(("", s) for s in np.unique(words.context(hits)).tolist() if s >= 0)
                        own.update((words.surface(h), 0) for h in hits[edits > 0].tolist())
                total.update((name, slot, y) for name, slot in own)
        rows = [(name, slot, n * y, n * (1 - y)) for (name, slot, y), n in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["name", "slot", "a", "b"])

    met = learn.mapInArrow(meet, "name string, slot int, a long, b long").groupBy("name", "slot").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    met = settle(met)
    for r in met.where("name <> ''").orderBy(F.desc(F.col("a") + F.col("b")), "name").limit(SURFACES).collect():
        held["surfaces"][r["name"]] = max(0.0, float(np.log((r["a"] + 1) / (n1 + 2) / ((r["b"] + 1) / (n0 + 2)))))
    slots = {r["slot"]: (r["a"], r["b"]) for r in met.where("name = ''").collect()}
    a, b = slots.pop(-1, (0, 0))
    share = (a + 1) / (a + b + 2)
    for slot, (a, b) in slots.items():
        held["context"][slot] = np.log((a + 10 * share) / (b + 10 * (1 - share))) - np.log(share / (1 - share))
    ready = context.broadcast(held)

    def describe(batches):
        automaton = Automaton(ready.value["entries"])
        for batch in batches:
            x = features(ready.value, automaton, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([v.tobytes() for v in x], pa.binary())], ["y", "x"])

    rows = sorted((bytes(r["x"]), r["y"]) for r in sample.where("model").select("text", "y").mapInArrow(describe, "y int, x binary").collect())
    x, y = np.array([np.frombuffer(v) for v, _ in rows]).reshape(-1, INPUTS), np.array([y for _, y in rows], float)
    n, toxic = sum(counts.values()), sum(v for (_, y), v in counts.items() if y)
    if 0 < y.sum() < len(y):
        held["model"] = fit_logistic(x, y)
    else:
        level = (toxic + 1e-6) / (n + 2e-6)
        held["model"] = (np.zeros(INPUTS), np.ones(INPUTS), np.zeros(INPUTS), float(np.log(level / (1 - level))))
    return held


def score(docs: DataFrame, held: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, held_out, score, predicted of every document."""
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def apply(batches):
        held = shared.value
        automaton = Automaton(held["entries"])
        centre, scale, weights, bias = held["model"]
        for batch in batches:
            x = features(held, automaton, batch.column("text").to_pylist())
            logit = (x - centre) / scale @ weights + bias
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(1 / (1 + np.exp(-np.clip(logit, -40, 40))))], ["id", "held_out", "score"])

    scored = rows.mapInArrow(apply, f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def mentions(docs: DataFrame, held: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, surface, entry, edits, quoted): every match, in code points."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(held["entries"])

    def find(batches):
        automaton, entries = Automaton(shared.value), shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out: list[tuple] = []
            for pieces in chunks(texts):
                words, hits, entry, edits = find_hits(automaton, pieces)
                quoted = words.quoted(hits) if len(hits) else []
                out += [
                    (int(words.row[h]), int(words.place[h]), int(words.place[h] + words.sizes[h]), words.surface(h), entries[e][0], int(d), bool(q))
                    for h, e, d, q in zip(hits.tolist(), entry.tolist(), edits.tolist(), quoted)
                ]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_())
            columns = [pa.array([o[i + 1] for o in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array([o[0] for o in out], pa.int64())), *columns], ["id", "start", "end", "surface", "entry", "edits", "quoted"])

    return rows.mapInArrow(find, f"id {rows.schema['id'].dataType.simpleString()}, start long, end long, surface string, entry string, edits int, quoted boolean")
