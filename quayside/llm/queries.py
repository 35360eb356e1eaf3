"""Queries of the training-data operators, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fill_middle, forest, hard_negatives, html_text, licenses, packing, quality, simhash, suffix_tree, token_lengths, url_rules, web_archives
from .common import table


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; null and empty html give an empty text."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels that are not held out."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document, learnt from those that are not held out."""
    out = suffix_tree.train_and_score(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document, with its edit distance."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's url ends with the number of the document it shows; its label counts for the page."""
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose vec_id is divisible by 20."""
    return forest.neighbours(table(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every length in tokens that a document has, with suffix sums for every limit."""
    lengths = token_lengths.encoded_lengths(table(spark, sf_dir, "documents"), tokenizer())
    return token_lengths.length_histogram(lengths)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2,048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their source's and language's folder."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.coalesce(F.col("doc_id").cast("string"), F.lit("_")))
    files = docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")
    return licenses.scan(files).withColumnRenamed("file_id", "doc_id")


def op11_web_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as an ARC record, converted to WARC and read back."""
    out = web_archives.archive(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive."""
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged, and rebuilt from that."""
    out = fill_middle.transform(table(spark, sf_dir, "documents"))
    restored = F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), restored)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_html_extraction, op2_quality_classifier, op3_suffix_tree_scores, op4_benchmark_decontamination,
        op5_url_filters, op6_nearest_neighbours, op7_token_counts, op8_simhash_near_dedup, op9_best_fit_packing,
        op10_license_scans, op11_web_archives, op12_hard_negatives, op13_fill_middle,
    )}


def _op1_sql() -> str:
    """The pages' article without its tags, for pages that mark it as this table's do."""
    body = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
    text = f"regexp_replace(regexp_replace({body}, '</?(p|h1|br)>', ' ', 'g'), '<[^>]+>', '', 'g')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&amp;", "&")):
        text = f"replace({text}, '{name}', '{char}')"
    text = f"trim(regexp_replace({text}, '[\\s\\p{{Z}}]+', ' ', 'g'))"
    return f"SELECT page_id, url, text, length(text) AS n_chars FROM (SELECT page_id, url, coalesce({text}, '') AS text FROM pages)"


def _op10_sql() -> str:
    quoted = lambda x: x.lower().replace("'", "''")
    may = lambda v: licenses.denies(re.findall(licenses.WORD, v.lower()))
    rows = ", ".join(f"({t}, '{k}', '{quoted(v)}', {may(v)})" for t, (k, v) in enumerate(licenses.templates()))
    known = ", ".join(f"'{x}': '{k}'" for x, k in licenses.identifiers().items())
    joined = licenses.EXPRESSION.replace("*+", "*").replace("++", "+")
    first = "list_min(list_filter([{0}], lambda k: k > 0))".format(", ".join(f"list_position(ws, '{x}')" for x in licenses.DENIALS))
    spelt = f"coalesce(map_extract(MAP {{{known}}}, lower(y))[1], CASE WHEN lower(y) IN ('and', 'or', 'with') THEN upper(y) ELSE y END)"
    tidy = "regexp_replace(replace(replace({0}, '( ', '('), ' )', ')'), '^[(]([^()]*)[)]$', '\\1')".format(f"array_to_string(list_transform(ts, lambda y: {spelt}), ' ')")
    filled = "len(list_filter(string_split({0}, chr(10)), lambda v: length(trim(v)) > 0))"
    return f"""
WITH tpl0(t, name, said, may_deny) AS (VALUES {rows}), tpl AS (SELECT *, said LIKE 'spdx-license-identifier:%' AS tag FROM tpl0), n AS (SELECT count(*) AS n FROM tpl),
tw AS (SELECT t, name, unnest(regexp_extract_all(said, '[a-z0-9]+')) AS word FROM tpl),
ttf AS (SELECT t, name, word, count(*) AS tf FROM tw GROUP BY ALL),
idf AS (SELECT word, ln((1 + n) / (1 + count(DISTINCT t))) + 1 AS idf FROM ttf, n GROUP BY word, n),
wt AS (SELECT t, name, word, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY t)) AS w FROM ttf JOIN idf USING (word)),
doc AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents),
split AS (SELECT doc_id, low, string_split_regex(low, '\n(?:[^a-z0-9\n]*\n)+') AS ps FROM doc),
para AS (SELECT doc_id, unnest(ps) AS said, generate_subscripts(ps, 1) AS p FROM split),
ln AS (SELECT doc_id, p, unnest(string_split(said, chr(10))) AS said, generate_subscripts(string_split(said, chr(10)), 1) AS l FROM para),
unit AS (SELECT doc_id, -1 AS p, -1 AS l, low AS said, {filled.format("low")} AS held FROM doc UNION ALL SELECT doc_id, p, -1, said, {filled.format("said")} FROM para UNION ALL SELECT doc_id, p, l, said, 1 FROM ln),
deny AS (SELECT doc_id, p, l FROM (SELECT doc_id, p, l, regexp_extract_all(said, '[a-z0-9]+') AS ws FROM unit) WHERE len(list_filter(ws[{first}:], lambda w: starts_with(w, 'licen'))) > 0),
ex AS (SELECT doc_id, {tidy} AS expr FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '{joined}', 1), lambda x: regexp_extract_all(x, '[()]|[A-Za-z0-9.+:-]+')), lambda x: len(list_filter(x, lambda y: len(map_extract(MAP {{{known}}}, lower(y))) > 0)) > 0)[1] AS ts FROM documents)),
tok AS (SELECT doc_id, p, l, held, unnest(regexp_extract_all(said, '[a-z0-9]+')) AS word FROM unit),
tf AS (SELECT doc_id, p, l, held, word, count(*) AS tf FROM tok GROUP BY ALL),
x AS (SELECT doc_id, p, l, held, word, tf * coalesce(idf, (SELECT ln(1 + n) + 1 FROM n)) AS x FROM tf LEFT JOIN idf USING (word)),
norm AS (SELECT doc_id, p, l, held, sqrt(sum(x * x)) AS norm FROM x GROUP BY ALL),
dots AS (SELECT doc_id, p, l, t, name, sum(x * w) AS dot FROM x JOIN wt USING (word) GROUP BY ALL),
cos AS (SELECT doc_id, p, l, held, dots.name, CASE WHEN tag THEN 1 ELSE 0 END AS tag, round(dot / norm, 6) AS score FROM dots JOIN norm USING (doc_id, p, l) JOIN tpl USING (t) LEFT JOIN (SELECT *, true AS denies FROM deny) USING (doc_id, p, l) WHERE may_deny OR denies IS NULL),
best AS (SELECT doc_id, p, l, held, max(score) AS score, min_by(name, (-score, name)) AS name, min_by(tag, (-score, name, -tag)) AS tag FROM cos WHERE score >= 0.8 GROUP BY ALL),
part AS (SELECT doc_id, p, greatest(coalesce(max(CASE WHEN l < 0 AND tag = 0 THEN held END), 0), count(CASE WHEN l >= 0 AND tag = 0 THEN 1 END)) AS lines FROM best GROUP BY ALL),
told AS (SELECT doc_id, greatest(sum(CASE WHEN p >= 0 THEN lines ELSE 0 END), max(CASE WHEN p < 0 THEN lines ELSE 0 END)) AS lines FROM part GROUP BY 1),
own AS (SELECT doc_id, max(score) AS own_score, min_by(name, (-score, name)) AS own_license FROM best GROUP BY 1),
f AS (SELECT d.doc_id, source || '/' || lang AS folder, source || '/' || lang || '/' || d.doc_id AS path, coalesce(expr, own_license) AS own_license, CASE WHEN expr IS NOT NULL THEN 1.0 ELSE own_score END AS own_score, coalesce(lines > 0 AND lines * 10 >= 9 * {filled.format("coalesce(text, '')")}, false) AS licence_file FROM documents d LEFT JOIN own ON own.doc_id = d.doc_id LEFT JOIN told ON told.doc_id = d.doc_id LEFT JOIN ex ON ex.doc_id = d.doc_id),
holds AS (SELECT folder, min_by(own_license, (-own_score, own_license)) AS folder_license FROM f WHERE licence_file GROUP BY 1)
SELECT doc_id, path, own_license, own_score, licence_file, coalesce(own_license, folder_license) AS license, CASE WHEN own_license IS NULL AND folder_license IS NOT NULL THEN f.folder END AS licensed_by
FROM f LEFT JOIN holds ON holds.folder = f.folder"""


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM f"""

OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.q, c.q) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h FROM documents),
t AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
x AS (SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS pre, coalesce(array_to_string(w[a+1:b], ''), '') AS mid, coalesce(array_to_string(w[b+1:n], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM x"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_html_extraction": _op1_sql(), "op10_license_scans": _op10_sql(), "op11_web_archives": OP11_SQL,
        "op12_hard_negatives": OP12_SQL, "op13_fill_middle": OP13_SQL,
    }
