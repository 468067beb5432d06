"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sojourn.llm import (
    conversation_trie,
    decontaminate,
    dual_tree_search,
    line_dedup,
    mixing,
    preferences,
    quality_classifier,
    quality_rules,
    repeated_windows,
    secret_ledger,
    simhash,
    token_store,
    toxicity,
)
from sojourn.llm.registry import QUERIES, SQL, query, table
from sojourn.operators.work import settle

__all__ = ["QUERIES", "SQL"]


@query()
def op3_quality_rules(spark, sf_dir):
    """Counts of every document, the base rule, and the verdict of the learned list."""
    counts = settle(quality_rules.with_counts(table(spark, sf_dir, "documents")))
    rules = quality_rules.learn(quality_rules.training_rows(counts, table(spark, sf_dir, "labels")))
    return quality_rules.judge(counts, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("rule"),
    )


@query()
def op10_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(rf"""
WITH bench AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (SELECT item, w, least(len(w), 13) AS k FROM bench WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT item, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM sized)
), docs AS (
  SELECT doc_id, coalesce(regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), places AS (
  SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k
), spots AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM places),
found AS (SELECT DISTINCT s.doc_id, s.i, s.k, b.item FROM spots s JOIN windows b ON s.win = b.win AND s.k = b.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op2_decontaminate(spark, sf_dir):
    """Benchmark windows found in every document, and the verdict."""
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query()
def op1_mix_sources(spark, sf_dir):
    """Words taken of every document."""
    return mixing.taken(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op6_token_store(spark, sf_dir):
    """Encode and write all documents, then read each back through the index."""
    store = token_store.write_store(table(spark, sf_dir, "documents"), tokenizer_path())
    return token_store.read_store(store).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def _spans_sql(kind: int, name: str, pattern: str, group: int, least: int) -> str:
    return f"""
  SELECT doc_id, {kind} AS kind, '{name}' AS name, i,
         length(array_to_string(b[1:i], '')) + coalesce(length(array_to_string(m[1:i - 1], '')), 0) AS s, length(m[i]) AS n, length(g[i]) AS gn, {least} AS least
  FROM (SELECT doc_id, m, g, b, unnest(generate_series(1, len(m))) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {group}) AS g, string_split_regex(text, '{pattern}') AS b FROM docs))"""


ASSIGN_SQL = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)


@query(rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS (
{_spans_sql(1, "assign", ASSIGN_SQL, 2, 6)} UNION ALL {_spans_sql(2, "access", "AKIA[A-Z0-9]+", 0, 20)} UNION ALL {_spans_sql(3, "hex", "[0-9a-f]+", 0, 24)}
), kept AS (SELECT doc_id, kind, name, s, name || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + n AS BIGINT) AS VARCHAR) AS span FROM spans WHERE gn >= least),
per AS (
  SELECT doc_id, count(*) FILTER (kind = 1) AS n_assign, count(*) FILTER (kind = 2) AS n_access, count(*) FILTER (kind = 3) AS n_hex,
         string_agg(span, ',' ORDER BY s, kind) AS spans FROM kept GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (doc_id)
""")
def op9_secret_ledger(spark, sf_dir):
    """Secrets of every document, scanned once per distinct text by a ledger that advances in parts."""
    found = secret_ledger.scan_in_parts(table(spark, sf_dir, "documents"))
    count = lambda name: F.size(F.filter("spans", lambda s: s["name"] == name)).cast("long").alias(f"n_{name}")
    line = secret_ledger.joined(F.col("spans"))
    return found.select(F.col("id").alias("doc_id"), *[count(r.name) for r in secret_ledger.BASE_RULES], F.sha2(line.cast("binary"), 256).alias("base_sha256"), line.alias("spans"))


@query()
def op5_quality_classifier(spark, sf_dir):
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model).withColumnRenamed("id", "doc_id")


@query()
def op4_repeated_windows(spark, sf_dir):
    """Bytes of every document that repeat a smaller document."""
    found = repeated_windows.repeated_spans(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


CRC32_SQL = """xor(4294967295, list_reduce(
  list_concat([4294967295::BIGINT], list_transform(range(1, length(CAST({0} AS VARCHAR)) + 1), lambda i: ascii(substr(CAST({0} AS VARCHAR), CAST(i AS INT), 1))::BIGINT)),
  lambda a, x: list_reduce(list_concat([xor(a, x)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda b, y: CASE WHEN b % 2 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END)))"""


@query(f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, text FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS LAST, text NULLS LAST) AS r FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL) WHERE r = 1
), answers AS (
  SELECT conv_id, min(turn) AS first, max(turn) AS last, {CRC32_SQL.format("conv_id")} % 3 AS kind FROM turns WHERE role = 'assistant' GROUP BY conv_id
), ends AS (SELECT conv_id, last, CASE WHEN kind = 0 THEN last ELSE first END AS at_turn, CASE WHEN kind = 1 THEN first ELSE last END AS until FROM answers),
chosen AS (SELECT * FROM turns JOIN ends USING (conv_id) WHERE turn <= last),
echo AS (SELECT conv_id, arg_max(coalesce(text, ''), turn) AS echo FROM chosen WHERE turn < at_turn GROUP BY conv_id),
sides AS (SELECT c.*, CASE WHEN turn = at_turn THEN coalesce(echo, '') ELSE text END AS other FROM chosen c LEFT JOIN echo USING (conv_id)),
cut AS (SELECT conv_id, min(turn) AS cut FROM sides WHERE turn > until OR text IS DISTINCT FROM other GROUP BY conv_id),
parts AS (
  SELECT conv_id, 'prompt' AS part, turn, role, text FROM sides LEFT JOIN cut USING (conv_id) WHERE cut IS NULL OR turn < cut
  UNION ALL SELECT conv_id, 'chosen', turn, role, text FROM sides JOIN cut USING (conv_id) WHERE turn >= cut
  UNION ALL SELECT conv_id, 'rejected', turn, role, other FROM sides JOIN cut USING (conv_id) WHERE turn >= cut AND turn <= until
)
SELECT conv_id, part, turn, role, '<|' || role || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS rendered,
       part <> 'prompt' AND role = 'assistant' AS train
FROM parts
""")
def op7_preference_pairs(spark, sf_dir):
    """Prompt and masked completions of every conversation with an answer, against its echo."""
    pairs = preferences.format_pairs(*preferences.echo_pairs(table(spark, sf_dir, "conversations")))
    return pairs.withColumnRenamed("pair", "conv_id")


@query()
def op8_line_dedup(spark, sf_dir):
    """Lines of every document that an earlier line repeats, within one edit."""
    found = line_dedup.report(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.array_join("removed", ",").alias("removed_lines"))


@query(rf"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t, turn FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
  SELECT c, r, t, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, r, sha256(CAST(length(r) AS VARCHAR) || ':' || r || t)) AS p FROM turns
), convs AS (SELECT c, list({{'r': r, 't': t}} ORDER BY p) AS l, {CRC32_SQL.format("c")} % 4 AS h FROM numbered GROUP BY c),
rebuilt AS (SELECT a.c, list_concat(coalesce(b.l[1:a.h], []), a.l[a.h + 1:]) AS l FROM convs a LEFT JOIN convs b ON b.c = a.c - a.c % 20),
visits AS (
  SELECT c, len(l) AS n, d, l[1:d] AS k, CASE WHEN d > 0 THEN l[1:d - 1] END AS above,
         CASE WHEN d > 0 THEN len(regexp_extract_all(l[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
  FROM (SELECT c, l, unnest(generate_series(0, len(l))) AS d FROM rebuilt)
), nodes AS (
  SELECT k, any_value(d) AS depth, any_value(above) AS above, min(c) AS conv, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
         string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = n) AS ends FROM visits GROUP BY k
), children AS (SELECT above AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY above),
sums AS (
  SELECT k[1:j] AS k, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved FROM (
    SELECT nodes.k, saved, children.n IS NULL AS leaf, unnest(generate_series(0, depth)) AS j FROM nodes LEFT JOIN children USING (k)) GROUP BY ALL
)
SELECT n.conv AS conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv AS parent_conv_id, n.n_convs, coalesce(children.n, 0) AS n_children, sums.n_leaves,
       CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN sums USING (k) LEFT JOIN children USING (k) LEFT JOIN nodes p ON n.depth > 0 AND p.k = n.above
""")
def op11_conversation_trie(spark, sf_dir):
    """Nodes of the prefix trie over the rebuilt conversations, with sums over their subtrees."""
    turns = settle(conversation_trie.ordered_turns(table(spark, sf_dir, "conversations")))
    nodes = conversation_trie.prefix_nodes(conversation_trie.spliced(turns, step=20, heads=4))
    return nodes.select(
        F.col("conv").cast("long").alias("conv_id"), "depth", F.col("parent_conv").cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), "ends_sha256",
    )


@query(rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), sized AS (SELECT row, doc_id, t, len(t) AS n FROM docs WHERE len(t) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sized),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), counts AS (
  SELECT row, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(t) AS term FROM sized) WHERE term IN (SELECT term FROM items) GROUP BY row, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), total
), scores AS (
  SELECT item_id, row, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // terms))))) AS BIGINT) AS score
  FROM items JOIN counts USING (term) JOIN weights USING (term), total GROUP BY item_id, row
), ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
""")
def op12_dual_tree_search(spark, sf_dir):
    """The ten best documents of every benchmark item."""
    found = dual_tree_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


@query()
def op13_toxicity(spark, sf_dir):
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
