"""Secret scans with an incremental ledger of blobs.

Every text is a blob named by its SHA-256. The ledger has a row for each (blob, rule,
version) that was ever scanned, with the spans found, also when there were none. A run
takes the distinct blobs of the paths it is given, leaves out the pairs the ledger
knows, scans the rest once per blob however many paths or versions share it, adds them
to the ledger, and joins findings back to all paths. Raising a rule's version scans all
blobs for that rule again and nothing else.

Rules are regular expressions, run by Spark's own functions: matches come from
``regexp_extract_all``, the text between them from ``split`` by the same expression, and
running lengths of both give the positions (in code points, end exclusive).

Defined results. A null text is the empty blob. Paths that repeat an id, and ids that are
null, keep their rows and get the findings of their text. An empty table gives an empty
result and adds nothing to the ledger. Extra columns never matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.llm.columns import let
from sojourn.operators.skew import keyed_join
from sojourn.operators.work import scratch_path, settle


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters. ``hint``
    must occur in every text with such a match; it is cheaper to look for."""

    name: str
    pattern: str
    group: int
    least: int
    hint: str
    version: int = 1


# Key words and shapes of the three base kinds, in their listed order.
# A run of at least 24, or 20, characters is the same as a whole run of that length, so
# these two rules carry the length in the pattern.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_RULES = (
    Rule("assign", ASSIGN, 2, 6, r"""(?i:passw(?:or)?d|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}"""),
    Rule("access", "AKIA[A-Z0-9]{16,}", 0, 20, "AKIA[A-Z0-9]{16}"),
    Rule("hex", "[0-9a-f]{24,}", 0, 24, "[0-9a-f]{24}"),
)
#: Matches of one short list; a text of n matches costs about n * (CHUNK + n / CHUNK**2) copies.
CHUNK = 128
#: Parts of the table that the query's ledger meets one after another.
PARTS = 3
LEDGER = "blob string, rule string, version int, spans array<struct<start: int, end: int>>"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of a rule's matches, leftmost and non-overlapping."""
    none = F.array().cast("array<struct<start: int, end: int>>")
    pattern = F.lit(rule.pattern)

    def walk(found: Column, between: Column, sized: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            begin = a["at"] + F.length(F.get(between, i))
            end = begin + F.length(F.get(found, i))
            span = F.struct(begin.alias("start"), end.alias("end"))
            kept = F.length(F.get(sized, i)) >= rule.least
            return F.struct(end.alias("at"), F.when(kept, F.array_append(a["out"], span)).otherwise(a["out"]).alias("out"))

        # Appending copies a list, so matches go to short lists, and these to the list of lists.
        def chunk(a: Column, first: Column) -> Column:
            own = F.aggregate(F.sequence(first, F.least(first + (CHUNK - 1), F.size(found) - 1)), F.struct(a["at"].alias("at"), none.alias("out")), step)
            return let(own, lambda o: F.struct(o["at"].alias("at"), F.array_append(a["out"], o["out"]).alias("out")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start: int, end: int>>>").alias("out"))
        firsts = F.sequence(F.lit(0), F.greatest(F.size(found) - 1, F.lit(0)), F.lit(CHUNK))
        return F.when(F.size(found) == 0, none).otherwise(F.aggregate(firsts, start, chunk, lambda a: F.flatten(a["out"])))

    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    group = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else None

    def positions(found: Column) -> Column:
        pieces = F.split(text, rule.pattern, -1)
        return let(pieces, lambda b: let(group, lambda g: walk(found, b, g)) if rule.group else walk(found, b, found))

    return F.when(text.rlike(rule.hint), let(whole, positions)).otherwise(none)


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.range(0).selectExpr("'' AS blob", "'' AS rule", "1 AS version", "array(struct(1 AS start, 1 AS end)) AS spans")


def _rules(rules) -> Column:
    return F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])


def scan_new(docs: DataFrame, ledger: DataFrame, rules=BASE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ledger rows for the pairs of ``docs``' blobs and ``rules`` that ``ledger`` lacks."""
    paths = docs.select(F.col(id_col).alias("id"), blob_of(F.col(text_col)).alias("blob"))
    # One path stands for a blob: the text is read from there.
    blobs = paths.groupBy("blob").agg(F.min("id").alias("id"))
    due = blobs.withColumn("r", F.explode(_rules(rules))).select("blob", "id", "r.rule", "r.version").join(ledger.select("blob", "rule", "version"), ["blob", "rule", "version"], "left_anti")
    due = settle(due.groupBy("blob", "id").agg(F.sort_array(F.collect_set("rule")).alias("due")).select(F.col("blob").alias("__blob"), F.col("id").alias("__id"), "due"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob", blob_of(F.col("text")))
    chosen = texts.join(due.hint("shuffle_hash"), (F.col("blob") == F.col("__blob")) & F.col("id").eqNullSafe(F.col("__id")))
    results = F.array(*[
        F.when(F.array_contains("due", r.name), F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans")))
        for r in rules
    ])
    scanned = chosen.select("blob", F.explode(F.filter(results, lambda x: x.isNotNull())).alias("x"))
    # An id may stand for a blob in several rows; they scan alike.
    return scanned.select("blob", "x.rule", "x.version", "x.spans").dropDuplicates(["blob", "rule", "version"])


def advance(docs: DataFrame, ledger_path: str, rules=BASE_RULES, id_col: str = "doc_id", text_col: str = "text", first: bool = False) -> DataFrame:
    """Scan what is new and append it to the ledger at ``ledger_path``; returns the ledger."""
    spark = docs.sparkSession
    ledger = empty_ledger(spark) if first else spark.read.schema(LEDGER).parquet(ledger_path)
    scan_new(docs, ledger, rules, id_col, text_col).write.mode("append").parquet(ledger_path)
    return spark.read.schema(LEDGER).parquet(ledger_path)


def findings(docs: DataFrame, ledger: DataFrame, rules=BASE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per path: id, blob, and ``spans``, an array of (start, kind, end, name) in text order,
    kinds in the order of ``rules`` where starts are equal."""
    current = ledger.join(F.broadcast(ledger.sparkSession.range(1).select(F.explode(_rules(rules)).alias("r")).select("r.rule", "r.version")), ["rule", "version"], "left_semi")
    kind = F.array_position(F.array(*[F.lit(r.name) for r in rules]), F.col("rule")).cast("int")
    each = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("kind").alias("kind"), s["end"].alias("end"), F.col("rule").alias("name")))
    found = current.where(F.size("spans") > 0).withColumn("kind", kind).select("blob", each.alias("s"))
    found = found.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("spans"))
    # Many paths may share a blob, such as the empty text; they are spread over salts.
    paths = settle(docs.select(F.col(id_col).alias("id"), blob_of(F.col(text_col)).alias("blob")))
    none = F.array().cast("array<struct<start: int, kind: int, end: int, name: string>>")
    joined_paths = keyed_join(paths, found, "blob", salt_by=["id"], how="left")
    return joined_paths.select("id", "blob", F.coalesce("spans", none).alias("spans"))


def joined(found: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, ledger_path: str | None = None, rules=BASE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Advance a ledger (a new one without ``ledger_path``) over ``docs`` and give their findings."""
    path = ledger_path or scratch_path(docs.sparkSession)
    return findings(docs, advance(docs, path, rules, id_col, text_col, first=ledger_path is None), rules, id_col, text_col)


def scan_in_parts(docs: DataFrame, parts: int = PARTS, rules=BASE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``scan`` with a new ledger that advances over ``parts`` parts of ``docs``, dealt by id
    hash, one after another: a blob that an earlier part held is not scanned again."""
    path, part = scratch_path(docs.sparkSession), F.pmod(F.xxhash64(F.col(id_col)), F.lit(parts))
    for k in range(parts):
        ledger = advance(docs.where(part == k), path, rules, id_col, text_col, first=k == 0)
    return findings(docs, ledger, rules, id_col, text_col)
