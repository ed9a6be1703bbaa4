"""The registered queries of the subpackage: one operator each, over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_table, chat_format, decontamination, fill_in_middle, ivfpq, language_mixture, media, parity_join, quality, source_mixing, toxicity, warc, whitening

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ivfpq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors by cosine of every vector whose id is divisible by 50."""
    return ivfpq.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back."""
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op3_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as PNG columns, and the features of what is read back."""
    return media.media_features(media.to_media(_table(spark, sf_dir, "documents")))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted and read back."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    return chat_format.chat_digests(chat_format.format_chats(turns.unionByName(more)))


def op5_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text."""
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text."""
    return language_mixture.identify(_table(spark, sf_dir, "documents"))


def op7_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return source_mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op8_bayes_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return parity_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op10_bpe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text, and their decoding."""
    return bpe_table.encode_decode(_table(spark, sf_dir, "documents"), VOCABULARY)


def op11_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every text that lie inside windows of the benchmark, and the items that these are of."""
    found = decontamination.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text transformed, and rebuilt from what came out."""
    found = fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(fill_in_middle.restored().cast("binary"), 256).alias("restored_sha256"))


def op13_svd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first four components."""
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"), components=4)
    return found.withColumns({"deviation": F.expr("try_cast(deviation as long)"), "deviation_exact": F.col("deviation")})


QUERIES = {f.__name__: f for f in (op1_ivfpq_search, op2_warc_reassembly, op3_png_media, op4_chat_format, op5_kneser_ney_toxicity, op6_language_mixture, op7_pivotal_mixing, op8_bayes_quality, op9_ngram_jaccard_join, op10_bpe_table, op11_wu_manber_decontamination, op12_fill_in_middle, op13_svd_whitening)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Where SQL can express the whole result.
ORACLE_SQL: dict[str, str] = {
    # bare base32: five bits of the digest at a time, eight characters for ten hexadecimal digits
    "op2_warc_reassembly": r"""WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
 d AS (SELECT *, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
 SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to,
  trim(regexp_replace(url, '\s+', ' ', 'g')) AS url, CAST(NULL AS VARCHAR) AS error FROM d""",
    "op4_chat_format": r"""WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
 SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars
 FROM t GROUP BY conv_id""",
    "op9_ngram_jaccard_join": rf"""WITH RECURSIVE w AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
 e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
 p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
 l AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
 r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.v FROM r JOIN l ON r.root = l.u),
 c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
 SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, CAST(c.root AS BIGINT) AS component_id FROM s JOIN c ON c.doc_id = s.doc_id""",
    "op11_wu_manber_decontamination": rf"""WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS ws FROM benchmark),
 win AS (SELECT DISTINCT item, least(10, len(ws)) AS k, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS x FROM b, unnest(range(1, greatest(len(ws) - 8, 2))) t(i) WHERE len(ws) > 0),
 d AS (SELECT row_number() OVER () AS rid, CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS ws FROM documents),
 dw AS (SELECT rid, k, i, array_to_string(ws[i:i + k - 1], ' ') AS x FROM d, (SELECT DISTINCT k FROM win) ks, unnest(range(1, len(ws) - k + 2)) t(i)),
 m AS (SELECT DISTINCT rid, dw.k, i, item FROM dw JOIN win ON win.k = dw.k AND win.x = dw.x),
 h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, k, i FROM m) o, unnest(range(i, i + k)) t(p) GROUP BY rid),
 n AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) o GROUP BY rid)
 SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN h USING (rid) LEFT JOIN n USING (rid)""",
    "op12_fill_in_middle": """WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS g FROM documents),
 h AS (SELECT doc_id, t, n, CAST('0x' || substr(g, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(g, 9, 8) AS BIGINT) % (n + 1) AS c2, CAST('0x' || substr(g, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(g, 25, 8) AS BIGINT) AS h4 FROM d),
 p AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(c1, c2) AS a, greatest(c1, c2) AS b FROM h)
 SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a) ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p""",
}
