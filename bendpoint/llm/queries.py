"""The registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import (
    collocations,
    decontam,
    embed_dedup,
    fim,
    html_main,
    langid,
    licenses,
    linededup,
    packing,
    pii,
    simhash,
    tokenids,
    toxicity,
)
from .common import scratch_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return out.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(langid.remainder("doc_id", 4) != 2))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (langid.remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(langid.remainder("doc_id", 5) != 0))
    return toxicity.judge(docs, model).select(
        "doc_id", (langid.remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted"
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_* and base_sha256 are of the base spans; spans are all, with those that the chain adds."""
    out = pii.find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select(
        "doc_id", *map(number, pii.KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans")
    )


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "token-ids")
    tokenids.write_ids(_table(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"))
    out = tokenids.read_ids(spark, folder)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.restore(fim.transform(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's first 2,000 phrases of each language."""
    out = collocations.collocations(_table(spark, sf_dir, "documents"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= 2000)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


QUERIES = {
    "op1_pack": op1_pack,
    "op2_langid": op2_langid,
    "op3_decontaminate": op3_decontaminate,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_personal_data": op7_personal_data,
    "op8_main_text": op8_main_text,
    "op9_token_ids": op9_token_ids,
    "op10_simhash": op10_simhash,
    "op11_licenses": op11_licenses,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_collocations": op13_collocations,
}

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op3_decontaminate": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
spans AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS span, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM spans),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS span
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, i, g.n, item_id FROM grams g JOIN spans s ON g.span = s.span AND g.n = s.n),
places AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM hits),
covered AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op5_line_dedup": rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT *, trim({_ASCII_LOWER.replace("coalesce(text, '')", "line")}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
r AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, r.last IS NOT NULL AND doc_id < r.last AS lost FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(lost AS INTEGER)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op12_fill_in_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS x FROM documents),
h AS (
  SELECT *, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
    CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4
  FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
o AS (SELECT *, substr(t, 1, p) AS a, substr(t, p + 1, q - p) AS m, substr(t, q + 1) AS s FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || a || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM o
""",
    "op13_collocations": rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_ASCII_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) AS t(k))),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT lang, phrase, a, x, unnest(range(1, len(x))) AS c
  FROM (SELECT *, string_split(phrase, ' ') AS x FROM f WHERE k > 1)),
scored AS (
  SELECT lang, cuts.phrase, cuts.a, c, p.a AS l, s.a AS r, n, (1000::HUGEINT * cuts.a * n) // (p.a::HUGEINT * s.a) AS score
  FROM cuts JOIN total USING (lang)
  JOIN f p USING (lang) JOIN f s USING (lang)
  WHERE p.phrase = array_to_string(x[1:c], ' ') AND s.phrase = array_to_string(x[c + 1:], ' ')),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (
  SELECT DISTINCT lang, array_to_string(x[i:j], ' ') AS phrase, a
  FROM (SELECT *, unnest(range(i + 1, len(x) + 1)) AS j
    FROM (SELECT lang, a, string_split(phrase, ' ') AS x, unnest(range(1, k)) AS i FROM f WHERE k > 2))
  WHERE j - i + 1 < len(x)),
kept AS (
  SELECT * FROM best b
  WHERE NOT EXISTS (FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.a >= 100 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
""",
}
