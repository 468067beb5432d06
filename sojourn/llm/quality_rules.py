"""Quality rules: a decision list learned by sequential covering.

Documents are described by statistics of their whole text. Rules are conjunctions of
thresholds (``symbols_per_word >= 0.4 and ...``) that mark bad documents. Sequential
covering learns them one at a time: grow a conjunction by the condition of highest
information gain until it covers no good document of the growing rows, prune it back to
the prefix that does best on the pruning rows, keep it if it is precise enough there,
take the covered rows away and go on. The list comes out as one ordered ``CASE``
expression.

Everything runs on DataFrame functions. Training rows are binned once at quantile cuts;
each step is one aggregate that returns at most features x bins counts, so the driver
holds a table whose size is set by the parameters. All labelled rows are used.

Defined results. Null and blank texts have no words and fail the base rule. Rows that
repeat an id are judged each on its own text. A document labelled more than once takes
its lowest label; null labels and labels without an id are ignored. Without labels of
both kinds the list is empty and only the base rule speaks. Extra columns never matter;
a result is built from the id, the text and the names documented here.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.llm.columns import SPACES, column, let, position, unpacked, whole_row, words
from sojourn.operators.work import settle

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Counts taken from a text, and the ratios that rules are learned on.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks")
#: Feature: count, and the count it is divided by (at least 1).
FEATURES = {
    "word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "words": ("n_words", None),
}


def feature(s: Column, name: str) -> Column:
    """A feature from a struct of COUNTS."""
    over, under = FEATURES[name]
    return s[over].cast("double") / (F.greatest(s[under], F.lit(1)) if under else F.lit(1))


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Windows are compared by a 64-bit hash within one document. Only a document with an
    equal pair is sorted; a position repeats if a neighbour in the order has its hash.
    """
    last = F.size(w) - 3

    def count(grams: Column) -> Column:
        pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda x, i: ((i > 0) & (F.get(s, i - 1)["g"] == x["g"])) | (F.coalesce(F.get(s, i + 1)["g"] == x["g"], F.lit(False)))
            return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["at"])).alias("n"), p.alias("at"))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(
            F.aggregate(let(pairs, positions), start, step, lambda a: a["n"])
        )

    grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(last < 1, 0).otherwise(let(grams, count))


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def text_counts(text: Column) -> Column:
    """Struct of COUNTS over a whole text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    upper = F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))

    def gather(w: Column, kept: Column) -> Column:
        values = {
            "n_words": F.size(w),
            "word_chars": F.length(F.translate(text, SPACES, "")),
            "n_symbols": _without(text, SYMBOLS),
            "n_dup_lines": F.size(kept) - F.size(F.array_distinct(kept)),
            "n_repeat_words": _repeat_words(w),
            "n_lines": F.size(kept),
            "n_upper": upper,
            "n_digits": _without(text, "0123456789"),
            "n_marks": _without(text, "!?"),
        }
        return F.struct(*[values[n].cast("long").alias(n) for n in COUNTS])

    return let(words(text), lambda w: let(lines, lambda kept: gather(w, kept)))


def base_failed(s: Column) -> Column:
    """The fixed rule: too short, or mostly repeated."""
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, s: Column) -> Column:
        value = feature(s, self.feature)
        return value >= self.cut if self.above else value < self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.cut:.4g}"


@dataclass(frozen=True)
class Rule:
    """``covered`` and ``precision`` are those on the pruning rows."""

    conditions: tuple[Condition, ...]
    covered: int
    precision: float

    def holds(self, s: Column) -> Column:
        return reduce(lambda a, b: a & b, [c.holds(s) for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


class DecisionList:
    """Ordered rules; the first that holds gives the reason to reject."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules

    def first_met(self, s: Column) -> Column:
        """An ordered conditional expression: the rule's number from 1, or null."""
        if not self.rules:
            return F.lit(None).cast("int")
        return reduce(lambda case, r: case.when(r[1].holds(s), r[0]), enumerate(self.rules, 1), F)


@dataclass(frozen=True)
class RuleSettings:
    """``bins``: cuts per feature. Rules stop at ``max_rules`` or when the best one is
    right on less than ``min_precision`` of the pruning rows it covers, or covers fewer
    than ``min_covered`` growing rows."""

    bins: int = 24
    max_rules: int = 8
    max_conditions: int = 3
    min_covered: int = 4
    min_precision: float = 0.9


def training_rows(counts: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(s, bad, grow) for each labelled document that passes the base rule."""
    label = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__q"))
    rows = counts.join(label, F.col(id_col) == F.col("__id"))
    grow = F.pmod(F.crc32(F.col("__id").cast("string")), F.lit(3)) != 0
    return rows.where(~base_failed(F.col("s"))).select("s", (F.col("__q") == 0).alias("bad"), grow.alias("grow"))


def learn(rows: DataFrame, settings: RuleSettings = RuleSettings()) -> DecisionList:
    """Sequential covering over ``training_rows``."""
    names = list(FEATURES)
    values = rows.select("bad", "grow", *[feature(F.col("s"), n).alias(n) for n in names])
    marks = [i / settings.bins for i in range(settings.bins)]
    bad = values.where("bad").agg(*[F.percentile_approx(n, marks, 10_000).alias(n) for n in names]).first()
    good = values.where("NOT bad").agg(*[F.percentile_approx(n, [0.0, 0.01, 0.1, 0.5, 0.9, 0.99, 1.0], 10_000).alias(n) for n in names]).first()
    if bad[0] is None or good[0] is None:
        return DecisionList([])
    # A cut half-way between a bad value and the next lower value, so that neither lies on it.
    cuts = {}
    for n in names:
        seen = sorted({*bad[n], *good[n]})
        cuts[n] = [(a + b) / 2 for a, b in zip(seen, seen[1:])]
    bins = F.array(*[F.expr(f"size(filter(array({','.join(f'{c!r}D' for c in cuts[n])}), c -> c <= {n}))") if cuts[n] else F.lit(0) for n in names])
    left = settle(values.select(bins.alias("b"), "bad", "grow").groupBy("b", "bad", "grow").agg(F.count("*").alias("n")))

    def inside(conditions) -> Column:
        out = F.lit(True)
        for f, above, k in conditions:
            at = F.col("b")[f]
            out = out & ((at > k) if above else (at <= k))
        return out

    rules, taken = [], F.lit(False)
    while len(rules) < settings.max_rules:
        open_rows = left.where(~taken)
        chosen: list[tuple[int, bool, int]] = []
        while len(chosen) < settings.max_conditions:
            grown = open_rows.where(F.col("grow") & inside(chosen))
            melted = grown.select(F.posexplode("b").alias("f", "k"), "bad", "n").groupBy("f", "k")
            table = melted.agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("g")).collect()
            best = _best_condition(table, names, cuts, settings.min_covered)
            if best is None:
                break
            chosen.append(best[0])
            if best[1] == 0:
                break
        if not chosen:
            break
        prefixes = [chosen[: i + 1] for i in range(len(chosen))]
        prune = open_rows.where(~F.col("grow")).agg(*[
            F.coalesce(F.sum(F.when(inside(p) & (F.col("bad") == b), F.col("n"))), F.lit(0)).alias(f"{'p' if b else 'g'}{i}")
            for i, p in enumerate(prefixes) for b in (True, False)
        ]).first()
        score = lambda i: (prune[f"p{i}"] - prune[f"g{i}"]) / max(prune[f"p{i}"] + prune[f"g{i}"], 1)
        at = max(range(len(prefixes)), key=lambda i: (score(i), -i))
        covered = prune[f"p{at}"] + prune[f"g{at}"]
        precision = prune[f"p{at}"] / covered if covered else 0.0
        if precision < settings.min_precision:
            break
        rules.append(Rule(tuple(Condition(names[f], above, cuts[names[f]][k]) for f, above, k in prefixes[at]), covered, precision))
        taken = taken | inside(prefixes[at])
    return DecisionList(rules)


def _best_condition(table, names, cuts, min_covered):
    """The (feature, above, cut) of highest gain, and the good rows it still covers."""
    counts = {(r["f"], r["k"]): (r["p"], r["g"]) for r in table}
    total = [sum(v[i] for k, v in counts.items() if k[0] == 0) for i in (0, 1)]
    if total[0] == 0 or total[1] == 0:
        return None
    base, best = log2(total[0] / sum(total)), None
    for f, name in enumerate(names):
        below = [0, 0]
        for k in range(len(cuts[name])):
            here = counts.get((f, k), (0, 0))
            below = [below[0] + here[0], below[1] + here[1]]
            for above in (True, False):
                p, g = (total[0] - below[0], total[1] - below[1]) if above else below
                if p < min_covered:
                    continue
                gain = p * (log2(p / (p + g)) - base)
                if gain > 0 and (best is None or gain > best[2] + 1e-9):
                    best = ((f, above, k), g, gain)
    return best[:2] if best else None


def with_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col), text_counts(F.col(text_col)).alias("s"))


def judge(counts: DataFrame, rules: DecisionList, id_col: str = "doc_id") -> DataFrame:
    """id, the counts, ``base_failed``, ``rule`` (number of the first rule met, or null), ``kept``."""
    s = F.col("s")
    rule = rules.first_met(s)
    return counts.select(
        id_col, *[s[n].alias(n) for n in COUNTS], base_failed(s).alias("base_failed"), rule.alias("rule"),
        (~base_failed(s) & rule.isNull()).alias("kept"),
    )


def learn_from(docs: DataFrame, labels: DataFrame, settings: RuleSettings = RuleSettings(), id_col: str = "doc_id", text_col: str = "text") -> DecisionList:
    """Learn from the labelled documents' whole texts.

    Counts are taken where the texts lie, and only they meet the labels.
    """
    counts = settle(with_counts(docs, id_col, text_col))
    return learn(settle(training_rows(counts, labels, id_col)), settings)


def keep_good(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """The documents that neither the base rule nor a learned rule rejects, all columns kept."""
    return docs.where(let(text_counts(F.col(text_col)), lambda s: ~base_failed(s) & rules.first_met(s).isNull()))


def sift(docs: DataFrame, labels: DataFrame, settings: RuleSettings = RuleSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``keep_good`` by rules learned from the same documents.

    Every text is counted once: the rows are settled with their counts beside them, the
    learning reads ids and counts only, and the filter moves no row.
    """
    counted = settle(docs.select(whole_row(docs).alias("row"), text_counts(column(text_col)).alias("s")))
    counts = counted.select(F.col("row").getField(position(docs, id_col)).alias(id_col), "s")
    rules = learn(settle(training_rows(counts, labels, id_col)), settings)
    s = F.col("s")
    return unpacked(counted.where(~base_failed(s) & rules.first_met(s).isNull()), docs)
