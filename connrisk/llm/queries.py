"""The queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from connrisk.llm.common import start, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(start(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


@register
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded by the multilingual rank file."""
    import public_tokenizers

    from connrisk.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@register
def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is a multiple of 20."""
    from connrisk.llm.neighbours import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@register
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles are 90 % alike."""
    from connrisk.llm.ngram_join import join

    return join(table(spark, sf_dir, "documents"), k=3, percent=90).drop("text_md5")


ORACLE["op3_ngram_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ')
                               ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s
  FROM words, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 2))) AS i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach AS (
  SELECT DISTINCT x AS origin, x AS found FROM links
  UNION SELECT r.origin, l.y FROM reach r JOIN links l ON l.x = r.found),
least AS (SELECT origin, min(found) AS c FROM reach GROUP BY origin)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, coalesce(least.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least ON least.origin = d.doc_id
"""


@register
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines held by an earlier document are dropped; digest of what stays."""
    from connrisk.llm.line_dedup import line_report

    return line_report(table(spark, sf_dir, "documents"))


ORACLE["op4_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
holders AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT a.doc_id, a.line, a.pos, (h.first_doc IS NOT NULL AND a.doc_id <> h.first_doc) AS gone
  FROM keyed a LEFT JOIN holders h ON a.k = h.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@register
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document, with its place."""
    from connrisk.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes, equal texts together."""
    from connrisk.llm.sharding import assign

    return assign(table(spark, sf_dir, "documents"), shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register
def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the end id, written as framed records in
    ascending doc_id order and read back from the files."""
    import public_tokenizers

    from connrisk.llm import token_records as R

    folder = R.new_folder(spark)
    manifest = R.write_records(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder, end_id=2)
    return R.record_digests(spark, folder, manifest)


@register
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learnt from four fifths of the documents."""
    from connrisk.llm.language_id import predict, train

    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))


@register
def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by a 50-byte string that starts in an earlier document, removed."""
    from connrisk.llm.repeats import repeat_report

    return repeat_report(table(spark, sf_dir, "documents"), window=50)


#: The rules of the url query, longest match first wins.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/")]


@register
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every page's url, by rule or by its host's trust and distrust."""
    from connrisk.llm.url_filters import judge

    return judge(table(spark, sf_dir, "pages"), URL_RULES)


@register
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every usable vector."""
    from connrisk.llm.whitening import whiten

    out = whiten(table(spark, sf_dir, "embeddings"), components=4)
    return out.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


@register
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text, by way of a ledger of its own."""
    from connrisk.llm.secrets import report

    return report(table(spark, sf_dir, "documents"))


#: Kinds, patterns, the group that is checked, its least length.
_SECRETS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32), ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1))
ORACLE["op12_secret_scan"] = "WITH " + ",\n".join(rf"""
m{i} AS (
  SELECT r, unnest(regexp_extract_all(t, '{pattern}', 0)) AS m, unnest(regexp_extract_all(t, '{pattern}', {group})) AS g,
         unnest(list_slice(string_split_regex(t, '{pattern}'), 1, -2)) AS gap,
         unnest(range(len(regexp_extract_all(t, '{pattern}', 0)))) AS i
  FROM docs),
f{i} AS (
  SELECT r, '{kind}' AS kind, {i} AS place, stop - length(m) AS start, stop
  FROM (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY r ORDER BY i) AS stop FROM m{i}) WHERE length(g) >= {least})"""
    for i, (kind, pattern, group, least) in enumerate(_SECRETS)).replace("\nm0 AS", """
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m0 AS""", 1) + r""",
found AS (SELECT *, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS s
          FROM (FROM f0 UNION ALL FROM f1 UNION ALL FROM f2 UNION ALL FROM f3))
SELECT doc_id, count(*) FILTER (WHERE place = 0) AS n_assign, count(*) FILTER (WHERE place = 1) AS n_access,
       count(*) FILTER (WHERE place = 2) AS n_hex,
       sha256(coalesce(string_agg(s, ',' ORDER BY start, place) FILTER (WHERE place < 3), '')) AS base_sha256,
       coalesce(string_agg(s, ',' ORDER BY start, place), '') AS spans, sha256(any_value(t)) AS blob
FROM docs LEFT JOIN found USING (r) GROUP BY r, doc_id
"""


@register
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    from connrisk.llm.lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


ORACLE["op13_lexical_search"] = r"""
WITH pattern AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u,
                        'abcdefghijklmnopqrstuvwxyz' AS l),
doc_terms AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), p) AS w FROM documents, pattern),
item_terms AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), p) AS w FROM benchmark, pattern),
totals AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS total FROM doc_terms WHERE len(w) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM doc_terms) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
            FROM tf, totals GROUP BY term, n_docs),
norms AS (SELECT r, doc_id, 75 + (25 * len(w) * n_docs) // total AS m FROM doc_terms, totals WHERE len(w) > 0),
asked AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS term FROM item_terms) GROUP BY ALL),
scores AS (SELECT q, item_id, r, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
           FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN norms USING (r) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 20
"""
