"""The queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.chat import format_conversations, read_back
from waymark.llm.decontaminate import contaminated_documents
from waymark.llm.hardneg import hard_negatives
from waymark.llm.interpolation import interpolated_scores
from waymark.llm.itq import near_vectors
from waymark.llm.language import identify_languages
from waymark.llm.lengths import length_histogram, limit_report
from waymark.llm.licenses import scan_licenses
from waymark.llm.merkle import fold, leaf_digest, merkle_manifest, proof_digest
from waymark.llm.minhash import near_duplicates
from waymark.llm.packing import pack_documents
from waymark.llm.pii import find_personal_data
from waymark.llm.secrets import scan_secrets


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_scores(_table(spark, sf_dir, "documents"), order=2)


def op2_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limit_report(length_histogram(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op3_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048)


def op6_winnowed_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op7_language_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op8_grammar_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op9_iterative_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), 0.93)


def op10_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_table(spark, sf_dir, "documents"))


def op11_dual_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _table(spark, sf_dir, "embeddings")
    return hard_negatives(v.withColumn("label", F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")), every=50, positives=5, negatives=3, low=50, high=95)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's proof checked against its own leaf, or against that of a text that lost its line ends."""
    docs = _table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    bare = leaf_digest(*(F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in fields))
    hurt = F.when((F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n")), bare)
    rows = merkle_manifest(docs, "doc_id", "source", leaf_digest(*(F.col(c) for c in fields)), {"tampered": hurt})
    folded = rows.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_offset_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds the template's own marks, read back from ids and masks."""
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    path = public_tokenizers.path("byte_bpe_50k.json")
    return read_back(format_conversations(given.unionByName(own), path), path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_deleted_interpolation": op1_deleted_interpolation,
    "op2_length_histogram": op2_length_histogram,
    "op3_prefix_decontamination": op3_prefix_decontamination,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_winnowed_licenses": op6_winnowed_licenses,
    "op7_language_field": op7_language_field,
    "op8_grammar_inference": op8_grammar_inference,
    "op9_iterative_quantisation": op9_iterative_quantisation,
    "op10_candidate_boosting": op10_candidate_boosting,
    "op11_dual_tree_negatives": op11_dual_tree_negatives,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_offset_masks": op13_offset_masks,
}

# Brute force: every window of every document against every item window.
_OP3 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) n, array_to_string(list_slice(w, s, s + least(10, len(w)) - 1), ' ') k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.s, dw.n, win.item_id FROM dw JOIN win ON dw.k = win.k AND dw.n = win.n),
words AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) p FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) n_items, string_agg(id, ',' ORDER BY id) ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# Brute force: sizes of all intersections by a join on shingles, components by label propagation.
_OP4 = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 3), ' ') k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) component_id, d.doc_id <= coalesce(m, d.doc_id) kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a doc_id, min(b) m FROM reach GROUP BY a) USING (doc_id)
"""

# Brute force: all pairs of one label.
_OP9 = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT x.vec_id a, y.vec_id b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, e.b FROM reach r JOIN links e ON r.b = e.a)
SELECT vec_id, coalesce(n, 0) n_links, least(vec_id, coalesce(m, vec_id)) component_id, vec_id <= coalesce(m, vec_id) kept
FROM embeddings LEFT JOIN (SELECT a vec_id, count(*) n FROM links GROUP BY a) USING (vec_id) LEFT JOIN (SELECT a vec_id, min(b) m FROM reach GROUP BY a) USING (vec_id)
"""

# Brute force: every anchor against every row.
_OP11 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id anchor_id, b.vec_id id, a.label = b.label same, list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) score FROM v a JOIN v b ON len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same AND id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) r, s.id negative_id, p.score positive_score, s.score negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, CAST(positive_score AS BIGINT) positive_score, CAST(negative_score AS BIGINT) negative_score FROM n WHERE r <= 3
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(strlen(CAST({0} AS VARCHAR)), ':', {0}) END"
_LEAF = ", ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
# Both levels of trees by recursion, siblings by a join on the run, crc32 bit by bit.
_OP12 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(concat('s', source), '') src, sha256(concat({_LEAF}, {_FIELD.format("text")})) leaf, sha256(concat({_LEAF}, {_FIELD.format("replace(text, chr(10), '')")})) hurt,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 i, count(*) OVER (PARTITION BY source) n,
  xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], CAST(range(8) AS BIGINT[])), lambda v, k: xor(v >> 1, 3988292384 * (v & 1))))) crc FROM documents),
a(src, level, i, h, n) AS (SELECT src, 0, i, leaf, n FROM d
  UNION ALL SELECT src, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM a WHERE n > 1 GROUP BY src, level, i // 3),
sub AS (SELECT src, h, row_number() OVER (ORDER BY src) - 1 r, count(*) OVER () m FROM a WHERE n = 1),
t(level, i, h, n) AS (SELECT 0, r, h, m FROM sub UNION ALL SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM t WHERE n > 1 GROUP BY level, i // 3),
path AS (SELECT d.doc_id, d.src, level, d.i // CAST(pow(3, level) AS BIGINT) i FROM d JOIN (SELECT DISTINCT src, level FROM a WHERE n > 1) USING (src)),
steps AS (SELECT doc_id, level, string_agg(CASE WHEN a.i < p.i THEN h END, '' ORDER BY a.i) b, string_agg(CASE WHEN a.i > p.i THEN h END, '' ORDER BY a.i) e FROM path p JOIN a USING (src, level) WHERE a.i // 3 = p.i // 3 GROUP BY 1, 2
  UNION ALL SELECT doc_id, 100 + level, string_agg(CASE WHEN t.i < p.i THEN h END, '' ORDER BY t.i), string_agg(CASE WHEN t.i > p.i THEN h END, '' ORDER BY t.i)
  FROM (SELECT doc_id, level, r // CAST(pow(3, level) AS BIGINT) i FROM d JOIN sub USING (src), (SELECT DISTINCT level FROM t WHERE n > 1)) p JOIN t USING (level) WHERE t.i // 3 = p.i // 3 GROUP BY 1, 2),
proof AS (SELECT doc_id, list(concat(b, '|', e) ORDER BY level) s, string_agg(concat(b, e), '' ORDER BY level) p FROM steps GROUP BY 1),
f AS (SELECT d.doc_id, leaf, sub.h subroot, (SELECT h FROM t WHERE n = 1) root, sha256(coalesce(p, '')) proof_sha256,
  list_reduce(list_concat([CASE WHEN crc % 2 = 0 THEN hurt ELSE leaf END], coalesce(s, [])), lambda x, y: sha256(concat(split_part(y, '|', 1), x, split_part(y, '|', 2)))) folded_root
  FROM d JOIN sub USING (src) LEFT JOIN proof USING (doc_id))
SELECT *, folded_root = root verified FROM f
"""

_ESCAPED = r"replace({0}, '\', '\\')"
for _mark in ("<turn>", "<text>", "</turn>", "<|endoftext|>"):
    _ESCAPED = f"replace({_ESCAPED}, '{_mark}', '{_mark[0]}\\{_mark[1:]}')"
_OP13 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role))
SELECT conv_id, count(*) n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) loss_chars, sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) loss_sha256,
  CAST(sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + 20) AS BIGINT) formatted_chars FROM c GROUP BY conv_id
"""

ORACLES: dict[str, str] = {
    "op3_prefix_decontamination": _OP3,
    "op4_minhash_near_dedup": _OP4,
    "op9_iterative_quantisation": _OP9,
    "op11_dual_tree_negatives": _OP11,
    "op12_merkle_manifest": _OP12,
    "op13_offset_masks": _OP13,
}
