"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotflow.llm import contamination, covertree, divergence, fptree, htmltext, language, lines, packing, pieces, simhash, topk, toxicity, urls
from slotflow.llm.common import held_out
from slotflow.llm.labelled_pages import LABELLED

RULES = [
    urls.Rule(urls.ALLOW, "com/"),
    urls.Rule(urls.BLOCK, "example.com/en/"),
    urls.Rule(urls.ALLOW, "www.example.com/en/"),
    urls.Rule(urls.BLOCK, "net/es/"),
    urls.Rule(urls.BLOCK, "net/fr/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    judged = toxicity.score(F.col("text"), model)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), judged.alias("r")).select(
        "doc_id", "held_out", "r.score", "r.predicted", "r.n_terms", "r.n_quoted"
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of a page is that of the document whose number its path holds: bad if of low quality or toxic."""
    marks = _table(spark, sf_dir, "labels").where("doc_id is not null and (quality is not null or toxic is not null)")
    bad = ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")
    outcomes = marks.groupBy(F.col("doc_id").alias("number")).agg(F.max(bad).alias("bad"))
    number = F.regexp_extract(urls.path_of(F.col("url")), "/([0-9]{1,18})(?:[/.]|$)", 1)
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.when(number != "", number.cast("long")).alias("number"))
    # Pages without a number meet no outcome: as one key of the join they would be one task's.
    known = pages.where("number is not null").join(outcomes, "number", "left").select("page_id", "url", "bad")
    rest = pages.where("number is null").select("page_id", "url", F.lit(None).cast("int").alias("bad"))
    judged = urls.judge(known.unionByName(rest), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    judged = language.identify(F.col("text"), language.fit(docs))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), judged.alias("r")).select(
        "doc_id", "held_out", "r.lang_pred", "r.score", "r.accepted"
    )


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document: how many, a digest of their ids, and whether decoding gives the text."""
    how = pieces.Sampler(public_tokenizers.path("piece_bpe_32k.model"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", pieces.encode(F.col("text"), F.col("doc_id"), how).alias("ids"))
    lossless = pieces.decode(F.col("ids"), how).eqNullSafe(F.col("text"))
    return docs.select("doc_id", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_xxhash64"), lossless.alias("lossless"))


def op5_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.98)


def op6_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, bits=4)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048, end=0)
    return packing.pack(cut, size=2048).withColumnRenamed("key", "doc_id")


def op8_topk_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.integers(_table(spark, sf_dir, "embeddings")), F.col("id") % 50 == 0)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    found = pages.select("page_id", "url", htmltext.main_text(F.col("html"), htmltext.fit(LABELLED)).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, removed="n_removed")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination.occurrences(docs, _table(spark, sf_dir, "benchmark"), length=10)
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fptree.top_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_url_filter,
        op3_language_id,
        op4_sentencepiece,
        op5_embedding_neardup,
        op6_simhash_neardup,
        op7_packing,
        op8_topk_inner_product,
        op9_html_text,
        op10_line_dedup,
        op11_source_divergence,
        op12_decontamination,
        op13_lexical_search,
    )
}

#: Host reputation of three levels, each with the spread of its groups as one scalar query.
_SHRUNK = """
  {name}_spread AS (
    SELECT greatest(least(coalesce(sum((x - n * mean) * (x - n * mean) - n * mean * (1 - mean)) / nullif(sum(n * mean * (1 - mean) * (n - 1)), 0), 1.0 / 1001), 0.5), 1.0 / 1001) AS r FROM {name}),
  {name}_post AS (
    SELECT *, (1 / r - 1) * mean + x AS a, (1 / r - 1) * (1 - mean) + (n - x) AS b FROM {name}, {name}_spread)"""

_URL_SQL = f"""
WITH marks AS (
  SELECT doc_id AS number, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
  rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail FROM pages),
  parts AS (
    SELECT page_id, translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
  named AS (
    SELECT p.*, m.bad FROM parts p
    LEFT JOIN marks m ON m.number = TRY_CAST(nullif(regexp_extract(p.path, '/([0-9]{{1,18}})(?:[/.]|$)', 1), '') AS BIGINT)),
  hosts AS (
    SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS x, regexp_replace(host, ':[0-9]*$', '') AS name FROM named GROUP BY host),
  placed AS (
    SELECT *, CASE WHEN NOT contains(name, '.') OR regexp_full_match(name, '[0-9.]*') THEN ''
                   WHEN regexp_matches(array_to_string(string_split(name, '.')[-2:], '.'), '{urls._two_parts(urls.Reputation())}')
                   THEN array_to_string(string_split(name, '.')[-2:], '.') ELSE string_split(name, '.')[-1] END AS suffix FROM hosts),
  sited AS (
    SELECT *, CASE WHEN suffix = '' THEN name WHEN contains(suffix, '.') THEN array_to_string(string_split(name, '.')[-3:], '.')
                   ELSE array_to_string(string_split(name, '.')[-2:], '.') END AS domain FROM placed),
  suffixes AS (
    SELECT suffix, sum(n) AS n, sum(x) AS x, (SELECT coalesce(sum(x) / nullif(CAST(sum(n) AS DOUBLE), 0), 0) FROM sited) AS mean FROM sited GROUP BY suffix),
{_SHRUNK.format(name="suffixes")},
  domains AS (
    SELECT s.suffix, s.domain, sum(s.n) AS n, sum(s.x) AS x, any_value(p.a / (p.a + p.b)) AS mean
    FROM sited s JOIN suffixes_post p ON s.suffix = p.suffix GROUP BY s.suffix, s.domain),
{_SHRUNK.format(name="domains")},
  known AS (
    SELECT s.host, s.n, s.x, p.a / (p.a + p.b) AS mean FROM sited s JOIN domains_post p ON s.suffix = p.suffix AND s.domain = p.domain),
{_SHRUNK.format(name="known")},
  bounds AS (
    SELECT host, a / (a + b) - 1.6448536269514722 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM known_post),
  rules(rule, verdict) AS (
    VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
  fits AS (
    SELECT p.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC) AS nth
    FROM parts p JOIN rules r
      ON (p.host = string_split(r.rule, '/')[1] OR ends_with(p.host, '.' || string_split(r.rule, '/')[1]))
     AND starts_with(p.path, substr(r.rule, instr(r.rule, '/'))))
SELECT n.page_id, n.host, n.path, f.rule,
       coalesce(f.verdict, CASE WHEN b.bound > 1.0 / 3 THEN 'block' ELSE 'allow' END) AS verdict
FROM named n JOIN bounds b ON n.host = b.host LEFT JOIN fits f ON f.page_id = n.page_id AND f.nth = 1
"""

SQL = {
    "op2_url_filter": _URL_SQL,
    "op8_topk_inner_product": topk.SQL,
    "op10_line_dedup": lines.SQL,
    "op11_source_divergence": divergence.SQL,
    "op12_decontamination": contamination.SQL,
    "op13_lexical_search": fptree.SQL,
}
