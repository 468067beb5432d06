"""Near-duplicate lines by a deletion-neighbourhood join, one edit apart.

Two lines within one edit share a variant: substituting a character leaves the same line
with that position deleted, and inserting one leaves the shorter line itself. So each line
gives its one-character deletions as hashed keys, and

* lines with the same (deletion, position) are one substitution apart from each other,
* a line and another's deletion that equals it are one insertion apart.

Per key only the earliest line is kept, an aggregate, so a key shared by many lines never
makes pairs. Each line then meets the earliest line of its keys, and that one pair is
verified by edit distance. A line goes if an equal or near line stands earlier in the
corpus (by document id, then line number), judged on the input.

Variants are as many as characters, so lines without a possible partner are left out
first, exactly: one edit spares the first or the last half of a line, so a line gives
hashes of its halves for both lengths it may have to match, and only a half that two
distinct lines share goes on, with variants from the other half alone.

Other edit bounds take patterns: the line with ``edits`` marks, each in the place of one
character or of none. Lines share a pattern exactly if they are that near, so the earliest
line per key decides here as well; pieces of the line take the part of its halves. Patterns
are about (2n)^edits / edits! of n characters, all of which are made, so the cost of more
than one edit grows with a power of the length.

Every line that is not empty is looked at, however short; empty lines part paragraphs and
all stay. ``min_chars`` leaves shorter lines alone where a caller wants that. Defined
results. Null and empty texts have one empty line. A null id
is later than every other; rows that repeat an id have their lines in one sequence, where
equal lines at equal places count as one, and unequal ones at equal places are ordered by their
hashes. Extra columns never matter; their names may be any.
"""

from __future__ import annotations

import sys
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.llm import kernels
from sojourn.llm.columns import position, unpacked, whole_row
from sojourn.operators.work import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_CHARS = 1
EDITS = 1
LINE = ["h1", "h2"]


def _prefix_sums(line: str):
    """Code points, prefix sums of their polynomial, and the inverse of its base."""
    points = np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    up, down = kernels._powers(len(points) + 2)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(points * up[: len(points)], out=sums[1:])
    return sums, down


def _hash(value, *salt):
    for s in salt:
        value = kernels.scramble(value + np.uint64(2 * s + 1))
    return value


def half_keys(line: Column) -> Column:
    """Array of (key, length to match, half that may differ) of a line's halves."""
    n, out = F.length(line), []
    for length in (n, n - 1):
        middle = F.floor(length / 2).cast("int")
        head, tail = F.substring(line, F.lit(1), middle), F.substring(line, n - length + middle + 1, length - middle)
        for half, same in ((1, head), (0, tail)):
            out.append(F.struct(F.xxhash64(F.lit(half), length, same).alias("key"), length.alias("length"), F.lit(half).alias("half")))
    return F.array(*out)


def variants(line: str, halves) -> list[tuple[int, int]]:
    """(key, role) of a line's deletions in the given (length, half) parts.

    Role 0: a deletion with its position. Role 1: the line itself, for insertions.
    Role 2: a deletion, to be found as another line itself.
    """
    sums, down = _prefix_sums(line)
    n, out = len(sums) - 1, []
    for length, half in halves:
        low, high = (0, length // 2) if half == 0 else (length // 2, length)
        at = np.arange(low, min(high + 1, n))
        gone = sums[at] + (sums[n:] - sums[at + 1]) * down[1:2]
        if length == n:
            keys = kernels.scramble(kernels.scramble(gone + np.uint64(n)) + at.astype(np.uint64) * np.uint64(2))
            out += [(k, 0) for k in keys.tolist()]
            out.append((int(_hash(sums[n:], n, 7)[0]), 1))
        else:
            out += [(k, 2) for k in _hash(gone, n - 1, 7).tolist()]
    return sorted(set(out))


def one_edit(a: str, b: str) -> bool:
    """Whether two lines are equal or one edit apart, in time linear in their length."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    apart = np.frombuffer(a[:n].encode("utf-32-le"), "<u4") != np.frombuffer(b[:n].encode("utf-32-le"), "<u4")
    i = int(np.argmax(apart)) if apart.any() else n
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def within(a: str, b: str, edits: int) -> bool:
    """Whether two lines are at most ``edits`` edits apart, by the band around the diagonal."""
    if abs(len(a) - len(b)) > edits:
        return False
    row = {j: j for j in range(min(edits, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        above, row = row, {}
        for j in range(max(0, i - edits), min(len(b), i + edits) + 1):
            steps = [above.get(j, edits) + 1, row.get(j - 1, edits) + 1]
            if j:
                steps.append(above.get(j - 1, edits + 1) + (x != b[j - 1]))
            row[j] = min(steps)
        if min(row.values()) > edits:
            return False
    return row.get(len(b), edits + 1) <= edits


def piece_keys(line: Column, edits: int) -> Column:
    """Array of keys of which lines within ``edits`` edits share one: of ``edits`` + 1 pieces one is spared."""
    n, out = F.length(line), []
    for shorter in range(edits + 1):
        length = n - shorter
        for i in range(edits + 1):
            low, high = (F.floor(length * x / (edits + 1)).cast("int") for x in (i, i + 1))
            for shift in range(-edits, edits + 1):
                out.append(F.xxhash64(F.lit(i), length, F.substring(line, F.greatest(low + shift + 1, F.lit(1)), high - low)))
    return F.array_distinct(F.array(*out))


def pattern_keys(line: str, edits: int):
    """Arrays of the keys of a line's patterns."""
    sums, down = _prefix_sums(line)
    n = len(sums) - 1
    for gone in range(min(edits, n) + 1):
        # A pattern is what remains and the gaps of it where marks stand, some of them twice.
        marks = kernels.scramble(np.arange(1, n - gone + 2, dtype=np.uint64))
        for first in combinations(range(n - 1), max(gone - 1, 0)):
            rest, stand, prev = np.zeros(1, np.uint64), np.zeros(1, np.uint64), -1
            for t, at in enumerate(first):
                rest = rest + (sums[at : at + 1] - sums[prev + 1]) * down[t]
                stand, prev = stand + marks[at - t], at
            if gone:
                at = np.arange(prev + 1, n)
                rest = rest + (sums[at] - sums[prev + 1]) * down[gone - 1] + (sums[n:] - sums[at + 1]) * down[gone]
                stand = stand + marks[at - gone + 1]
            else:
                rest = rest + sums[n:]
            own = kernels.scramble(rest + kernels.scramble(np.full(1, n - gone + 1, np.uint64))) + stand
            for more in combinations_with_replacement(range(len(marks)), max(edits - gone - 1, 0)):
                free = marks[more[-1] if more else 0 :] if gone < edits else np.zeros(1, np.uint64)
                for m in more:
                    free = free + marks[m : m + 1]
                step = max(1, 65536 // len(free))
                for k in range(0, len(own), step):
                    yield np.unique(own[k : k + step, None] + free)


def _verify(edits: int):
    near = one_edit if edits == 1 else lambda a, b: within(a, b, edits)

    def check(batches):
        for batch in batches:
            kept = [near(a, b) for a, b in zip(batch.column("line").to_pylist(), batch.column("other").to_pylist())]
            yield batch.select(["h1", "h2", "late", "id", "no", "o1", "o2"]).filter(pa.array(kept, pa.bool_()))

    return check


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, no, line) of the lines that are long enough."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text, "\n", -1)).alias("no", "line"))
    return rows.where(F.length("line") >= min_chars)


def _hashes():
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), F.col("line")).alias("h2")]


def _place(*more):
    return F.min(F.struct(F.col("id").isNull().alias("late"), "id", "no", *more)).alias("first")


def _emit_variants(id_type):
    def scan(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [variants(line, [(x["length"], x["half"]) for x in halves]) for line, halves in zip(part.column("line").to_pylist(), part.column("halves").to_pylist())]
                row = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                keys = np.array([k for f in found for k, _ in f], np.uint64).view(np.int64)
                roles = np.array([r for f in found for _, r in f], np.int32)
                own = [part.column(c).take(row) for c in ("late", "id", "no", "h1", "h2")]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(roles), *own], ["key", "role", "late", "id", "no", "h1", "h2"])

    return scan


def _by_deletions(distinct: DataFrame, kind: str):
    """(candidates, met) of one edit: each line with the earliest line ``o`` of its keys."""
    halves = distinct.select(*LINE, F.explode(half_keys(F.col("line"))).alias("k")).select(*LINE, "k.*")
    shared = halves.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    possible = halves.join(shared, "key", "left_semi").groupBy(*LINE).agg(F.collect_set(F.struct("length", "half")).alias("halves"))
    candidates = settle(distinct.join(possible, LINE))

    keys = settle(candidates.mapInArrow(_emit_variants(kind), f"key long, role int, late boolean, id {kind}, no int, h1 long, h2 long"))
    earliest = lambda role: F.min(F.when(F.col("role") == role, F.struct("late", "id", "no", "h1", "h2")))
    groups = keys.groupBy("key").agg(F.count("*").alias("n"), *[earliest(r).alias(f"e{r}") for r in (0, 1, 2)]).where("n > 1").drop("n")
    met = keys.join(groups, "key").withColumn("o", F.expr("CASE role WHEN 0 THEN e0 WHEN 1 THEN e2 ELSE e1 END")).where("o IS NOT NULL")
    return candidates, met


def _emit_patterns(edits: int):
    def scan(batches):
        for batch in batches:
            for at, line in enumerate(batch.column("line").to_pylist()):
                own = batch.slice(at, 1).select(["late", "id", "no", "h1", "h2"])
                for keys in pattern_keys(line, edits):
                    row = pa.array(np.zeros(len(keys), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *[c.take(row) for c in own.columns]], ["key", *own.schema.names])

    return scan


def _by_patterns(distinct: DataFrame, kind: str, edits: int):
    """(candidates, met) of any edit bound: each line with the earliest line ``o`` of its keys."""
    pieces = distinct.select(*LINE, F.explode(piece_keys(F.col("line"), edits)).alias("key"))
    shared = pieces.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    candidates = settle(distinct.join(pieces.join(shared, "key", "left_semi").select(*LINE).distinct(), LINE))
    keys = settle(candidates.mapInArrow(_emit_patterns(edits), f"key long, late boolean, id {kind}, no int, h1 long, h2 long"))
    earliest = keys.groupBy("key").agg(F.min(F.struct("late", "id", "no", "h1", "h2")).alias("o"), F.count("*").alias("n")).where("n > 1").drop("n")
    return candidates, keys.join(earliest, "key")


def near_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, edits: int = EDITS) -> DataFrame:
    """(h1, h2, late, id, no, o1, o2): distinct lines with an earlier line within ``edits`` edits, and that line."""
    lines = _lines(docs, id_col, text_col, min_chars)
    kind = lines.schema["id"].dataType.simpleString()
    distinct = lines.select("*", *_hashes()).groupBy(*LINE).agg(_place("line")).select(*LINE, "first.*")

    candidates, met = _by_deletions(distinct, kind) if edits == 1 else _by_patterns(distinct, kind, edits)
    before = met.where(F.col("o") < F.struct("late", "id", "no", "h1", "h2")).groupBy(*LINE).agg(F.min("o").alias("o")).select(*LINE, F.col("o.h1").alias("o1"), F.col("o.h2").alias("o2"))

    mine = candidates.select(*LINE, "late", "id", "no", "line")
    theirs = candidates.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("other"))
    pairs = before.join(mine, LINE).join(theirs, ["o1", "o2"])
    return pairs.mapInArrow(_verify(edits), f"h1 long, h2 long, late boolean, id {kind}, no int, o1 long, o2 long")


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, edits: int = EDITS) -> DataFrame:
    """(id, no, h1, h2): place and hashes of the lines looked at that stay, one row each."""
    near = near_lines(docs, id_col, text_col, min_chars, edits).select(*LINE)
    firsts = _lines(docs, id_col, text_col, min_chars).select("id", "no", *_hashes()).groupBy(*LINE).agg(_place())
    return firsts.join(near, LINE, "left_anti").select(F.col("first.id").alias("id"), F.col("first.no").alias("no"), *LINE)


def _removed(docs: DataFrame, id_col: str, text_col: str, min_chars: int, edits: int) -> DataFrame:
    """(id, version, removed): numbers of the lines that go, in order, for each distinct text of an id.

    A line stays if its place and its hashes are those of a kept line; each line asks for itself.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n", -1)).alias("no", "line")).where(F.length("line") >= min_chars)
    asked = rows.select("id", "version", "no", *_hashes())
    kept = settle(kept_lines(docs, id_col, text_col, min_chars, edits)).select(F.col("id").alias("kept_id"), F.col("no").alias("kept_no"), F.col("h1").alias("k1"), F.col("h2").alias("k2"))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("no") == F.col("kept_no")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))
    gone = asked.join(kept, same, "left_anti")
    return gone.groupBy("id", "version").agg(F.array_sort(F.collect_set("no")).alias("removed"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, edits: int = EDITS) -> DataFrame:
    """Per document: id, number of lines, number and numbers (from 0) of those removed."""
    n_lines = F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("version"), n_lines.alias("n_lines"))
    gone = _removed(docs, id_col, text_col, min_chars, edits).select(F.col("id").alias("gone_id"), F.col("version").alias("gone_version"), "removed")
    found = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("version") == F.col("gone_version")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return found.select("id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, edits: int = EDITS) -> DataFrame:
    """The documents with their repeated lines taken out; other columns stay."""
    gone = _removed(docs, id_col, text_col, min_chars, edits)
    whole = docs.select(whole_row(docs).alias("row"))
    text, key = F.col("row").getField(position(docs, text_col)), F.col("row").getField(position(docs, id_col))
    version = F.xxhash64(F.coalesce(text, F.lit("")))
    found = whole.join(gone, key.eqNullSafe(F.col("id")) & (version == F.col("version")), "left")
    lines = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(F.coalesce("removed", F.array().cast("array<int>")), i))
    return unpacked(found, docs, {text_col: F.array_join(lines, "\n")})
