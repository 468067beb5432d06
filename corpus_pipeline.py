"""From raw documents to token ids: quality rules, near-dedup, decontamination, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; the
result is written as Parquet and reread as the next stage's ``docs``. Scratch tables of a
stage are removed when the next one starts, as its result is on disk by then.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from sojourn.llm import decontaminate, mixing, quality_rules, simhash, token_store
from sojourn.llm.queries import tokenizer_path
from sojourn.operators.work import mark, release, scratch_path

_scratch: list[tuple[int, int]] = []


def _stage(fn):
    @wraps(fn)
    def run_stage(spark, docs, sf_dir):
        while _scratch:
            release(spark, *_scratch.pop())
        since = mark()
        out = fn(spark, docs, sf_dir)
        _scratch.append((since, mark()))
        return out

    return run_stage


@_stage
def quality(spark, docs, sf_dir):
    """Documents that the base rule and the learned decision list let pass."""
    return quality_rules.sift(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def near_dedup(spark, docs, sf_dir):
    """The first document of each group within 3 bits, over 3-word shingles."""
    return simhash.keep_one(docs, shingle=3, max_bits=3)


@_stage
def decontaminated(spark, docs, sf_dir):
    """Documents that are not contaminated by a benchmark item."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "documents")


@_stage
def mixed(spark, docs, sf_dir):
    """Documents as often as the mix takes them."""
    return mixing.apply_mix(docs)


@_stage
def encoded(spark, docs, sf_dir):
    """Token ids written to shards and read back through the index, one row per document copy."""
    store = token_store.write_store(docs, tokenizer_path())
    return token_store.read_store(store).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_dedup),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token ids", encoded),
]

#: The learned rules and the drawn mix are not SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        since = mark()
        path = scratch_path(spark)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if read is not None:
            release(spark, read, read + 1)
        read = since
    return STAGES[-1][1](spark, docs, sf_dir)
