"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigweave.llm.near_dup import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigweave.llm.line_dedup import dedup_lines

    docs = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.selectExpr("doc_id", "cast(n_lines as long) as n_lines", "cast(n_removed as long) as n_removed", "cast(length(text) as long) as kept_chars", "sha2(text, 256) as kept_sha256")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigweave.llm.decontaminate import leaks

    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigweave.llm.quality_model import scored

    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigweave.llm.chat import digests, formatted

    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digests(formatted(turns.union(more)))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sigweave.llm.bpe import encoded

    tokens = encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), decode=True)
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigweave.llm.quality_rules import judged

    out = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sigweave.llm.language_id import identified, train

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = train(docs.filter(~held_out), public_tokenizers.path("piece_bpe_32k.model"))
    return identified(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigweave.llm.pii import KINDS, as_text, found, train

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = found(docs, train(docs))

    def count(i: int):  # noqa: ANN202
        return F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"), F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.concat("base", "added")).alias("spans"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sigweave.llm.lm_scoring import scored, train

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    trained, counts = train(docs.filter(~held_out), path)
    out = scored(docs, trained, counts, path)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigweave.llm.merkle import verified

    return verified(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigweave.llm.whitening import fit, identity_error, whitened

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = fit(rows)
    return whitened(rows, model, error=identity_error(rows, model) if model else None)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sigweave.llm.secrets import KINDS, as_text, found

    out = found(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))

    def count(i: int):  # noqa: ANN202
        return F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return out.select("doc_id", *counts, F.size("added").cast("long").alias("n_added"), F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.concat("base", "added")).alias("spans"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


SQL = {
    "op1_chat_formatting": r"""WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss, length(text) + length(regexp_replace(text, '[^\\<\[\]]', '', 'g')) + CASE role
  WHEN 'system' THEN length('<<SYS>>x') + length('x<</SYS>>x') WHEN 'user' THEN length('[INST] ') + length(' [/INST]') WHEN 'assistant' THEN length('<a> ') + length(' </s>x')
  ELSE length('[ROLE ] ') + length(role) + length(regexp_replace(role, '[^\\<\[\]]', '', 'g')) + length(' [/ROLE]x') END AS chars FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, sum(length(loss))::BIGINT AS loss_chars,
  sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars,
  regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text), 's?(ua)+') AS valid FROM t GROUP BY conv_id""",
    "op10_minhash_near_dedup": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS reach FROM documents UNION SELECT r.id, b FROM r JOIN both_ways ON reach = a),
m AS (SELECT id, min(reach) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op11_merkle_manifest": r"""WITH RECURSIVE f AS (SELECT doc_id, source, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
  || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS said, list_transform(range(0, 8 * length(doc_id::VARCHAR)), lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::BIGINT, 1)) ELSE 0 END) AS bits FROM documents),
leaves AS (SELECT doc_id, source, sha256(said || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(said || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS low,
  coalesce(xor(list_reduce(bits, lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)), 4294967295), 4294967295) % 5 = 0, false) AS marked FROM f),
placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM leaves),
up AS (SELECT 0 AS lvl, s, r AS p, leaf AS h, count(*) OVER (PARTITION BY s) AS n FROM placed
  UNION ALL SELECT lvl, s, p, h, count(*) OVER (PARTITION BY s) FROM (SELECT lvl + 1 AS lvl, s, p // 16 AS p, sha256(string_agg(h, '' ORDER BY p)) AS h FROM up WHERE n > 1 GROUP BY 1, 2, 3)),
tops AS (SELECT s, h, lvl FROM up WHERE n = 1),
over AS (SELECT 0 AS lvl, s - 1 AS p, h, count(*) OVER () AS n FROM tops
  UNION ALL SELECT lvl, p, h, count(*) OVER () FROM (SELECT lvl + 1 AS lvl, p // 16 AS p, sha256(string_agg(h, '' ORDER BY p)) AS h FROM over WHERE n > 1 GROUP BY 1, 2)),
runs AS (SELECT s, lvl, p // 16 AS q, string_agg(h, '' ORDER BY p) AS hs FROM (SELECT s, lvl, p, h, n FROM up UNION ALL SELECT 0, lvl, p, h, n FROM over) WHERE n > 1 GROUP BY 1, 2, 3),
walk AS (SELECT s, r, 0 AS lvl, r AS p, CASE WHEN marked THEN low ELSE leaf END AS h, '' AS proof FROM placed
  UNION ALL SELECT w.s, r, w.lvl + 1, p // 16, sha256(hs[:64 * (p % 16)] || h || hs[64 * (p % 16) + 65:]), proof || hs[:64 * (p % 16)] || hs[64 * (p % 16) + 65:] FROM walk w JOIN runs ON runs.s = w.s AND runs.lvl = w.lvl AND q = p // 16),
climb AS (SELECT s, r, 0 AS lvl, s - 1 AS p, w.h, proof FROM walk w JOIN tops USING (s, lvl)
  UNION ALL SELECT w.s, r, w.lvl + 1, p // 16, sha256(hs[:64 * (p % 16)] || h || hs[64 * (p % 16) + 65:]), proof || hs[:64 * (p % 16)] || hs[64 * (p % 16) + 65:] FROM climb w JOIN runs ON runs.s = 0 AND runs.lvl = w.lvl AND q = p // 16),
root AS (SELECT lvl, h AS root FROM over WHERE n = 1)
SELECT doc_id, leaf, tops.h AS subroot, root, sha256(proof) AS proof_sha256, c.h AS folded_root, c.h = root AS verified FROM placed JOIN tops USING (s) JOIN climb c USING (s, r) JOIN root ON root.lvl = c.lvl""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
