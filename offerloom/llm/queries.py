"""The operators bound to the given tables: one query each, with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

import os
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom import registry
from offerloom.llm import knn, lines, maxent, merkle, minhash, mixing, packing, pii, quality, radix, substring, suffix, whitening

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; Python workers find this package where the driver found it."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _ROOT not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{_ROOT}:{paths}".rstrip(":")
    return registry.table(spark, sf, name)


def tokenizer() -> str:
    """The vocabulary file of the packing query; on a cluster, a path that every executor has."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@registry.query("op1_best_fit_packing")
def op1(spark, sf):
    return packing.pack(table(spark, sf, "documents"), tokenizer(), 2048)


@registry.query("op2_exact_top_k", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""")
def op2(spark, sf):
    v = knn.scaled(table(spark, sf, "embeddings"), "vec_id", "embedding", 256)
    return knn.top_k(v, v.filter("vec_id % 50 = 0"), 5)


@registry.query("op3_quality_classifier")
def op3(spark, sf):
    return quality.judged(table(spark, sf, "documents"), ["doc_id"]).select("doc.doc_id", "score", "kept")


@registry.query("op4_minhash_near_dedup")
def op4(spark, sf):
    out = minhash.near_groups(table(spark, sf, "documents"), 85, 5)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@registry.query("op5_mixing_sources")
def op5(spark, sf):
    out = mixing.plan_mix(table(spark, sf, "documents"), ["doc_id"])
    return out.select("doc.doc_id", "size", "source", "source_size", "target", "taken", "shards")


@registry.query("op6_line_dedup", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
v AS (SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS t FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l)),
rep AS (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS r FROM v WHERE regexp_matches(t, '[^ \\t\\n\\v\\f\\r]')),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM rep, (VALUES (0), (1), (2)) x(k) WHERE r > 1),
every AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM l)
SELECT e.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, sha256(coalesce(string_agg(e.line, chr(10) ORDER BY e.i) FILTER (WHERE g.i IS NULL), '')) AS kept_sha256
FROM every e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY 1""")
def op6(spark, sf):
    out = lines.remove_repeated_lines(table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@registry.query("op7_pii")
def op7(spark, sf):
    out = pii.personal_data(table(spark, sf, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@registry.query("op8_exact_dedup", """WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS c, translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS t FROM documents),
g AS (SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY c DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g""")
def op8(spark, sf):
    out = radix.exact_groups(table(spark, sf, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.sha2("normalised", 256).alias("text_sha256"))


@registry.query("op9_substring_dedup")
def op9(spark, sf):
    out = substring.remove_repeated_words(table(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@registry.query("op10_suffix_array_dedup")
def op10(spark, sf):
    out = suffix.remove_repeated_bytes(table(spark, sf, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@registry.query("op11_lm_scoring")
def op11(spark, sf):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return maxent.score(table(spark, sf, "documents"), held_out, ["doc_id"]).select("doc.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@registry.query("op12_embedding_whitening")
def op12(spark, sf):
    out = whitening.whiten(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return out.select(F.col("id").alias("vec_id"), "n", "deviation", F.inline("components"))


@registry.query("op13_merkle_manifest", """WITH RECURSIVE
f AS (SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head, text, regexp_replace(coalesce(lang, ''), '^', CASE WHEN lang IS NULL THEN '' ELSE '=' END) AS tree,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 3 = 0 AS changed FROM documents),
d AS (SELECT doc_id, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  CASE WHEN changed THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS given FROM f),
up(tree, lvl, pos, n, h) AS (SELECT tree, 0, pos, n, leaf FROM d
  UNION ALL SELECT tree, lvl + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, lvl, pos // 8),
sub AS (SELECT tree, h, lvl, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top(lvl, pos, n, h) AS (SELECT 0, pos, n, h FROM sub
  UNION ALL SELECT lvl + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 8),
path(doc_id, tree, lvl, pos) AS (SELECT doc_id, tree, 0, pos FROM d UNION ALL SELECT p.doc_id, p.tree, p.lvl + 1, p.pos // 8 FROM path p JOIN sub s USING (tree) WHERE p.lvl < s.lvl),
above(tree, lvl, pos) AS (SELECT tree, 0, pos FROM sub UNION ALL SELECT tree, lvl + 1, pos // 8 FROM above WHERE lvl < (SELECT max(lvl) FROM top)),
sides AS (SELECT p.doc_id, p.lvl, coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (WHERE u.pos < p.pos), '') AS l, coalesce(string_agg(u.h, '' ORDER BY u.pos) FILTER (WHERE u.pos > p.pos), '') AS r
    FROM path p JOIN sub s USING (tree) JOIN up u ON u.tree = p.tree AND u.lvl = p.lvl AND u.pos // 8 = p.pos // 8 WHERE p.lvl < s.lvl GROUP BY p.doc_id, p.lvl
  UNION ALL SELECT d.doc_id, s.lvl + a.lvl, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (WHERE t.pos < a.pos), ''), coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (WHERE t.pos > a.pos), '')
    FROM d JOIN sub s USING (tree) JOIN above a USING (tree) JOIN top t ON t.lvl = a.lvl AND t.pos // 8 = a.pos // 8 WHERE a.lvl < (SELECT max(lvl) FROM top) GROUP BY d.doc_id, s.lvl, a.lvl),
fold(doc_id, lvl, h) AS (SELECT doc_id, 0, coalesce(given, leaf) FROM d UNION ALL SELECT g.doc_id, g.lvl + 1, sha256(s.l || g.h || s.r) FROM fold g JOIN sides s ON s.doc_id = g.doc_id AND s.lvl = g.lvl),
ended AS (SELECT doc_id, arg_max(h, lvl) AS folded_root FROM fold GROUP BY 1),
proof AS (SELECT d.doc_id, sha256(coalesce(string_agg(l || r, '' ORDER BY x.lvl), '')) AS proof_sha256 FROM d LEFT JOIN sides x USING (doc_id) GROUP BY 1),
root AS (SELECT h AS root FROM top WHERE n = 1)
SELECT d.doc_id, d.leaf, s.h AS subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM d JOIN sub s USING (tree) JOIN ended USING (doc_id) JOIN proof USING (doc_id), root""")
def op13(spark, sf):
    docs = table(spark, sf, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    given = F.when(changed, merkle.leaf_digest(*map(F.col, fields[:-1]), lower))
    return merkle.manifest(docs, fields, "lang", "doc_id", given).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
