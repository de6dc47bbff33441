"""The queries of the numbered operators: each applies its operator to whole tables and derives digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetable.llm import bpe, decontaminate, language, lines, quality, repeats, secrets, simhash, spelling
from pagetable.llm import tokenfile, toxicity, vectors, whitening
from pagetable.llm.store import folder

END_ID = 2


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# rows of an Arrow batch: texts are long, and the default of 10,000 rows takes tens of megabytes in worker and executor
BATCH_ROWS = 1536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_ids(docs: DataFrame) -> DataFrame:
    coded = bpe.encode(docs.select("doc_id", "text"), tokenizer(), keep=["doc_id"])
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_ids(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = folder(spark, "token-files")
    tokenfile.write_token_files(table(spark, sf_dir, "documents"), tokenizer(), out, END_ID)
    read = tokenfile.read_token_files(spark, out)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


OP2_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_at AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM item_at),
doc_at AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT d.doc_id, d.p, d.n, v.item_id FROM
  (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM doc_at) d JOIN win v ON d.n = v.n AND d.s = v.s),
word AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP6_SQL = """
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
holder AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE first < doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE first IS NULL OR first >= doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN holder USING (key) GROUP BY doc_id
"""


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    evidence = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, evidence).select("doc_id", "low_quality", "toxic", "keep")


def _is(kind: str):
    return lambda k: k == kind


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = secrets.infer(secrets.labelled_samples(docs))
    found = secrets.scan(docs.select("doc_id", "text"), learned, keep=["doc_id"])
    kinds = F.transform("spans", lambda s: s.kind)
    counts = [F.size(F.filter(kinds, _is(k))).cast("long").alias(f"n_{k}") for k in secrets.KINDS[:3]]
    told = F.transform("spans", lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s["end"].cast("string")))
    base = F.filter(told, lambda s: ~s.startswith("format:"))
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(told, ",").alias("spans"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    samples = language.training_texts(docs.where((fold != 2) & F.col("lang").isNotNull()).select("text", "lang"), "text", "lang")
    told = language.identify(docs.select("doc_id", "text"), samples, keep=["doc_id"])
    return told.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(fold != 0))
    told = toxicity.score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return told.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE fine AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
many AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON e.vec_id = least.a LEFT JOIN many ON e.vec_id = many.a
"""


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_decontaminate": op2_decontaminate,
    "op3_bpe": op3_bpe,
    "op4_repeats": op4_repeats,
    "op5_quality": op5_quality,
    "op6_lines": op6_lines,
    "op7_secrets": op7_secrets,
    "op8_language": op8_language,
    "op9_token_files": op9_token_files,
    "op10_vectors": op10_vectors,
    "op11_toxicity": op11_toxicity,
    "op12_spelling": op12_spelling,
    "op13_whitening": op13_whitening,
}
SQL = {"op2_decontaminate": OP2_SQL, "op6_lines": OP6_SQL, "op10_vectors": OP10_SQL}
