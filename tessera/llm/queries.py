"""The registered queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crosstok, decontam, divergence, jaccard, linededup, mixing, pii, quality, suffix, tokencount, tokenfile, urlfilter, warc

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
BYTE_BPE = "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(warc.read(spark, warc.write(spark, table(spark, sf_dir, "pages")), with_data=False))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(table(spark, sf_dir, "documents")))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(spark, table(spark, sf_dir, "pages")).drop("class_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(decontam.find(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(spark, table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(spark, table(spark, sf_dir, "documents"), tokencount.vocabulary(tokenizer_path(PIECES)))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(spark, table(spark, sf_dir, "documents")).drop("copies")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfile.write(spark, table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))
    return tokenfile.read(spark, manifest).drop("part")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(spark, table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spark, table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(suffix.dedup(spark, table(spark, sf_dir, "documents")))


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.align(spark, table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), tokenizer_path(PIECES))


QUERIES = {f.__name__: f for f in (op1_warc, op2_pii, op3_url_filter, op4_decontamination, op5_quality, op6_token_counts, op7_mixing, op8_line_dedup, op9_token_files, op10_jaccard_join, op11_divergence, op12_suffix_dedup, op13_cross_tokenizer)}

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BASE32 = "list_aggregate(list_transform(range(32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substring(h, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1)::BIGINT, 1)), 'string_agg', '')"

ORACLES: dict[str, str] = {
    "op1_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS b, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(b)::BIGINT AS payload_bytes, {BASE32} AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
    "op4_decontamination": r"""WITH b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS k FROM b, LATERAL (SELECT unnest(range(0, greatest(1, len(w) - 9))) AS i) WHERE len(w) > 0), sizes AS (SELECT DISTINCT n FROM win),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS k FROM d, sizes, LATERAL (SELECT unnest(range(0, len(w) - n + 1)) AS i)),
hit AS (SELECT doc_id, i, dw.n, item FROM dw JOIN win USING (k) WHERE dw.n = win.n), words AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op5_quality": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 5], ' ') AS k FROM d, LATERAL (SELECT unnest(range(0, len(w) - 4)) AS i)), rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT doc_id, text, w, l, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR n_symbols > 0.25 * n_words OR n_dup_lines > 0.5 * len(l) OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR len(regexp_extract_all(text, '!')) > 0.5 * n_words
OR len(regexp_extract_all(text, '\\p{{Lu}}')) > 0.7 * len(regexp_extract_all(text, '\\p{{L}}')) OR len(list_filter(range(2, n_words + 1), lambda i: w[i] = w[i - 1])) > 0.5 * n_words) AS kept FROM f""",
    "op8_line_dedup": f"""WITH x AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS l FROM documents), u AS (SELECT source, trim(unnest(l), {SPACES}) AS line FROM x WHERE source IS NOT NULL),
bad AS (SELECT line FROM u WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 5), lines AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM x), j AS (SELECT lines.*, trim(lines.line, {SPACES}) AS t, bad.line IS NOT NULL AS gone FROM lines LEFT JOIN bad ON bad.line = trim(lines.line, {SPACES}))
SELECT doc_id, count(CASE WHEN t <> '' THEN 1 END)::BIGINT AS n_lines, count(CASE WHEN gone THEN 1 END)::BIGINT AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS text_sha256 FROM j GROUP BY doc_id""",
    "op10_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + least(5, len(w))], ' ') AS k FROM d, LATERAL (SELECT unnest(range(0, greatest(1, len(w) - 4))) AS i) WHERE len(w) > 0), n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (k) WHERE x.doc_id < y.doc_id GROUP BY ALL), e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.v = d.doc_id GROUP BY ALL""",
    "op11_divergence": r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d), v AS (SELECT lang, term, count(*) AS ln FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30), g AS (SELECT DISTINCT lang, source FROM d),
z AS (SELECT lang, count(*) AS vn, sum(ln) AS lt FROM v GROUP BY lang), c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL), k AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, v.ln FROM g JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
s AS (SELECT lang, source, sum(n) AS total FROM k GROUP BY ALL), p AS (SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * vn))::BIGINT AS p, (1 + (1000000000::HUGEINT * (ln + 5)) // (lt + 5 * vn))::BIGINT AS q FROM k JOIN s USING (lang, source) JOIN z USING (lang)),
two AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(two.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN two ON two.lang = a.lang AND two.source = a.source AND two.item = b.source),
u AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q), o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM u)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM o WHERE part = 'pair' OR rank <= 50""",
}
