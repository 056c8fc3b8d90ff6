"""The registered queries of this subpackage and the DuckDB twins of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.llm import (
    line_dedup, mixing, neighbours, packing, periodic, pitman_yor, quality, secrets, sharding, simhash, suffix_dedup, toxicity, variants,
)
from kpiforge.llm.common import table, words

TOKENIZER = "word_bpe_49k.json"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (host: source) without their source's boilerplate lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs).select("doc_id", "source", "lines.n_lines", "lines.n_dropped", "text")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that 200-byte strings found twice cover, cut from every document."""
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).drop("spans")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens, each in the sources' proportions."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitman-Yor log10 probabilities of all documents."""
    return pitman_yor.score(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each document under the sources' target weights."""
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = F.col("mix.size") * F.col("mix.copies")
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", taken.alias("taken"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 8 shards of nearly equal bytes."""
    dealt = sharding.shard(table(spark, sf_dir, "documents"))
    return dealt.withColumn("grown_shard", F.lit(None).cast("int"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and the components of those within 2 bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th vector."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of all documents, learnt from the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, toxicity.grades_of(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select("doc_id", "toxicity.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of the line-first rules for all documents."""
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "quality.*").drop("clean_text")


def _looped(text: Column, doc_id: Column) -> Column:
    """The texts that op11's contract asks for: of every tenth document (by the checksum of its id), the words from a on repeat with period p."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, ws = F.floor(h / 10).cast("long"), words(text)
    n = F.when(F.size(ws) > 0, F.size(ws))
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    loop = F.flatten(F.array_repeat(F.slice(ws, a + 1, p), F.ceil((n - a) / p).cast("int")))
    looped = F.concat(F.slice(ws, F.lit(1), a), F.slice(loop, F.lit(1), n - a))
    return F.when(h % 10 == 0, F.coalesce(F.array_join(looped, " "), text)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, and the texts without their repeats as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _looped(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic.collapse(docs).select("doc_id", "periodic.*")
    order = lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")
    )
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.array_max(F.transform("runs", order)).alias("top"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )
    length, period = F.col("top.length"), -F.col("top.period")
    return best.select(
        "doc_id", "n_runs", (-F.col("top.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def _letter_runs(docs: DataFrame) -> DataFrame:
    """The words of op12's contract: runs of six letters and more, lower-cased, some with one letter left out."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    run = F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z\u00C0-\u00FF]{6,})"), 1))
    runs = docs.select("doc_id", run.alias("run")).select("doc_id", F.translate("run", upper, upper.lower()).alias("run"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    gap = (h % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), gap), F.col("run").substr(gap + 2, F.length("run")))
    return runs.select(F.when(h % 199 == 0, cut).otherwise(F.col("run")).alias("word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of all documents with their near words, forms and roots."""
    return variants.group(_letter_runs(table(spark, sf_dir, "documents")))


def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spelt = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    of = lambda kind: F.filter("secrets", lambda s: s["kind"] == kind)
    kinds = [kind for kind, *_ in secrets.BASE]
    base = F.filter("secrets", lambda s: s["kind"].isin(kinds))
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(spelt(base), 256).alias("base_sha256"), spelt("secrets").alias("spans"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline of corpus_pipeline.py."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_WORD = r"[^\x20\x09-\x0D]"
_LINES = "string_split(text, chr(10))"

OP1_SQL = f"""
WITH pages AS (SELECT source AS host, count(*) AS n FROM documents GROUP BY ALL),
lines AS (SELECT source AS host, unnest(list_distinct(list_filter({_LINES}, lambda x: regexp_matches(x, '{_WORD}')))) AS line
          FROM documents),
seen AS (SELECT host, line, count(*) AS c FROM lines GROUP BY ALL),
gone AS (SELECT s.host, list(line) AS lines FROM seen s JOIN pages p ON s.host IS NOT DISTINCT FROM p.host
         WHERE c >= {line_dedup.MIN_PAGES} AND c > {line_dedup.RATIO}::DOUBLE * n GROUP BY s.host),
cleaned AS (SELECT doc_id, source, text, {_LINES} AS own,
                   list_filter({_LINES}, lambda x: NOT list_contains(coalesce(g.lines, []), x)) AS kept
            FROM documents d LEFT JOIN gone g ON d.source IS NOT DISTINCT FROM g.host)
SELECT doc_id, source, coalesce(len(own), 0)::BIGINT AS n_lines, coalesce(len(own) - len(kept), 0)::BIGINT AS n_dropped,
       CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text
FROM cleaned
"""

OP5_SQL = f"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}+'))::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place FROM src),
weighed AS (SELECT source, source_size, CASE place WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
                   2.0::DOUBLE * source_size AS cap FROM placed),
whole AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS all_ FROM src),
levels AS (SELECT cap, w, cap / w AS ratio,
                  (all_ - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
           FROM weighed, whole),
chosen AS (SELECT level FROM levels WHERE level * w <= cap ORDER BY ratio LIMIT 1),
targets AS (SELECT source, source_size, least(level * w, cap) AS target FROM weighed, chosen),
rated AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                 ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
          FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""

_TERMINAL = ", ".join("'" + c.replace("'", "''") + "'" for c in quality.TERMINAL)
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}+') AS ws, {_LINES} AS lines FROM d),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + {quality.WINDOW - 1}], ' ') AS win
            FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - {quality.WINDOW - 1})) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) WHERE c > 1),
cover AS (SELECT doc_id, sum(least({quality.WINDOW}, coalesce(next_ - i, {quality.WINDOW})))::BIGINT AS n
          FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next_ FROM twice) GROUP BY doc_id),
facts AS (
  SELECT w.doc_id, text, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(list_filter(lines, lambda x: regexp_matches(x, '{_WORD}')))
          - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '{_WORD}')))))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         array_to_string(list_filter(lines, lambda x: NOT regexp_matches(x, '{_WORD}') OR NOT (
             right(rtrim(x, {_SPACES}), 1) NOT IN ({_TERMINAL})
             OR length(x) - length(regexp_replace(x, '[{quality.NAV_MARKS}]', '', 'g'))
                > {quality.NAV_SHARE}::DOUBLE * len(regexp_extract_all(x, '{_WORD}+'))
                AND regexp_matches(x, '[{quality.NAV_MARKS}]')
             OR length(x) < {quality.MAX_NOTICE} AND regexp_matches(lower(x), '{"|".join(quality.PHRASES)}'))), chr(10)) AS clean
  FROM w LEFT JOIN cover c ON w.doc_id = c.doc_id),
judged AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed
           FROM facts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND length(clean) >= {1 - quality.MAX_LOST}::DOUBLE * length(text) AS kept
FROM judged
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_suffix_dedup, op3_packing, op4_lm_scoring, op5_mixing, op6_sharding, op7_simhash,
        op8_neighbours, op9_toxicity, op10_quality_rules, op11_periodic_runs, op12_spelling_variants, op13_secret_scans, pipeline,
    )
}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {"op1_line_dedup": OP1_SQL, "op5_mixing": OP5_SQL, "op10_quality_rules": OP10_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
