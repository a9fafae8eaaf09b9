"""One query per operator over its whole table, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline.llm import (
    bpe,
    codes,
    embeddings,
    fingerprints,
    licenses,
    mixing,
    packing,
    quality,
    ranked,
    simhash,
    substrings,
    url_lists,
    warc,
)
from siftline.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return register


@query()
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), path)


WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

MIXING_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS k, CAST({WORDS_SQL} AS BIGINT) AS size,
    md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
sources AS (
  SELECT k, source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY k, source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
    WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2.0::DOUBLE * source_size AS cap FROM sources),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
      - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY cap / w, k) AS spot FROM weighed),
level AS (SELECT arg_min(level, spot) AS level FROM levels WHERE cap > level * w),
targets AS (
  SELECT k, source_size, least(cap, coalesce(level.level * w, cap)) AS target,
    CASE WHEN source_size > 0
      THEN CAST(floor(least(cap, coalesce(level.level * w, cap)) / source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM weighed, level),
ordered AS (
  SELECT doc_id, source, size, source_size, target, epochs,
    CAST(floor(target) AS BIGINT) - epochs * source_size - coalesce(sum(size) OVER (
      PARTITION BY k ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM sizes JOIN targets USING (k))
SELECT doc_id, source, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, room)) AS BIGINT) AS taken FROM ordered"""


@query(MIXING_SQL)
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


@query()
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_report(table(spark, sf_dir, "documents"))


@query()
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op1_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


@query()
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, sf_dir, "documents"))


# --- Files with paths: every document lies in a tree below its source ------------------------

FILES_SQL = """SELECT doc_id, text, source || CASE WHEN doc_id % 512 = 0 THEN ''
    WHEN doc_id % 64 = 0 THEN '/d' || CAST(floor(doc_id / 512) AS BIGINT)
    ELSE '/d' || CAST(floor(doc_id / 512) AS BIGINT) || '/e' || CAST(floor(doc_id % 512 / 64) AS BIGINT) END
  || CASE WHEN doc_id % 8 = 0 THEN '/LICENSE' ELSE '/f' || doc_id || '.txt' END AS path FROM documents"""

_TEMPLATE_ROWS = ", ".join(f"('{n}', '{t}')" for n, t in licenses.TEMPLATES.items())
_TERMS = f"regexp_extract_all(lower({{}}), '{licenses.TERM}')"

LICENSES_SQL = f"""
WITH files AS ({FILES_SQL}),
templates AS (SELECT * FROM (VALUES {_TEMPLATE_ROWS}) AS t(name, body)),
tt AS (SELECT name, term, count(*) AS c FROM
  (SELECT name, unnest({_TERMS.format("body")}) AS term FROM templates) GROUP BY name, term),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
  unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM files),
found AS (SELECT doc_id, i, term, count(*) AS tf FROM
  (SELECT doc_id, i, unnest({_TERMS.format("line")}) AS term FROM lines) GROUP BY doc_id, i, term),
held AS (SELECT term, count(DISTINCT doc_id) AS d FROM found WHERE term IN (SELECT term FROM tt) GROUP BY term),
n AS (SELECT count(*) AS n FROM files),
w AS (SELECT term, ln((1.0::DOUBLE + n) / (1 + coalesce(d, 0))) + 1 AS w
  FROM (SELECT DISTINCT term FROM tt) LEFT JOIN held USING (term), n),
rare AS (SELECT ln(1.0::DOUBLE + n) + 1 AS r FROM n),
lengths AS (SELECT name, sqrt(sum((c * w) ** 2)) AS length FROM tt JOIN w USING (term) GROUP BY name),
own AS (SELECT doc_id, i, sqrt(sum(CASE WHEN w IS NULL THEN tf * r * r ELSE (tf * w) ** 2 END)) AS length
  FROM found LEFT JOIN w USING (term), rare GROUP BY doc_id, i),
scores AS (SELECT f.doc_id, f.i, tt.name, round(sum(f.tf * tt.c * w.w * w.w) / any_value(l.length) / any_value(own.length), 6) AS score
  FROM found AS f JOIN tt USING (term) JOIN w USING (term) JOIN lengths AS l USING (name)
  JOIN own ON own.doc_id = f.doc_id AND own.i = f.i GROUP BY f.doc_id, f.i, tt.name),
per_line AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY score DESC, name) = 1),
best AS (SELECT * FROM per_line QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, name DESC) = 1),
scanned AS (SELECT doc_id, path, name AS own_license, score AS own_score,
  regexp_replace(path, '/[^/]*$', '') AS directory
  FROM files LEFT JOIN (SELECT * FROM best WHERE score >= {licenses.THRESHOLD}) USING (doc_id)),
dirs AS (SELECT directory, own_license AS license FROM scanned
  WHERE own_license IS NOT NULL AND path LIKE '%/LICENSE'
  QUALIFY row_number() OVER (PARTITION BY directory ORDER BY own_score DESC, own_license) = 1),
nearest AS (SELECT s.doc_id, d.directory, d.license FROM scanned AS s
  JOIN dirs AS d ON s.directory = d.directory OR starts_with(s.directory, d.directory || '/')
  QUALIFY row_number() OVER (PARTITION BY s.doc_id ORDER BY length(d.directory) DESC) = 1)
SELECT s.doc_id, s.path, own_license, own_score, coalesce(own_license, n.license) AS license,
  CASE WHEN own_license IS NOT NULL THEN s.path ELSE n.directory END AS license_from
FROM scanned AS s LEFT JOIN nearest AS n USING (doc_id)"""


@query(LICENSES_SQL)
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.sql(FILES_SQL.replace("FROM documents", "FROM {docs}"), docs=table(spark, sf_dir, "documents"))
    return licenses.scan_licenses(files)


# --- Captures with a day, and a list whose entries come and go -------------------------------

DAY = "date_add(DATE'2024-01-01', CAST({} % 365 AS INT))"
_ENTRY_KINDS = {
    0: "host",
    1: "concat(host, '/en/')",
    2: "regexp_replace(host, '^[^.]*[.]', '')",
    3: "host",
    4: "concat(host, '/fr/')",
    5: "host",
}
_ENTRY_ROWS = " UNION ALL ".join(
    f"SELECT {pattern} AS pattern, {DAY.format(f'(length(host) * 37 + {k} * 61)')} AS since, "
    f"CASE (length(host) + {k}) % 4 WHEN 0 THEN 'allow' WHEN 3 THEN 'remove' ELSE 'block' END AS action FROM hosts"
    for k, pattern in _ENTRY_KINDS.items()
)


def _duck(sql: str) -> str:
    return sql.replace("date_add(DATE'2024-01-01', ", "(DATE '2024-01-01' + ")


URL_LISTS_SQL = _duck(f"""
WITH captures AS (SELECT page_id, url, {DAY.format("(page_id * 7919)")} AS fetched,
  regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '[.]$', '') AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
hosts AS (SELECT DISTINCT host FROM captures WHERE host <> ''),
entries AS (SELECT pattern, since, max(CASE action WHEN 'block' THEN 2 WHEN 'allow' THEN 1 ELSE 0 END) AS rank
  FROM ({_ENTRY_ROWS}) GROUP BY pattern, since),
spans AS (SELECT *, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until,
  regexp_extract(pattern, '^([^/]*)', 1) AS phost, regexp_extract(pattern, '^[^/]*(.*)$', 1) AS ppath FROM entries),
hits AS (SELECT page_id, pattern, CASE rank WHEN 2 THEN 'block' ELSE 'allow' END AS action
  FROM captures JOIN spans ON (host = phost OR ends_with(host, '.' || phost))
    AND (ppath = '' OR path = ppath OR (ends_with(ppath, '/') AND starts_with(path, ppath)))
    AND since <= fetched AND (until IS NULL OR until > fetched)
  WHERE rank > 0
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, action DESC, pattern DESC) = 1)
SELECT page_id, fetched, pattern, action, coalesce(action = 'block', false) AS blocked
FROM captures LEFT JOIN hits USING (page_id)""")


@query(URL_LISTS_SQL)
def op7_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.expr(DAY.format("(page_id * 7919)")))
    hosts = pages.select(url_lists.url_host(F.col("url")).alias("host")).where("host <> ''").distinct()
    entries = spark.sql(_ENTRY_ROWS.replace("FROM hosts", "FROM {hosts}"), hosts=hosts)
    return url_lists.judge(captures, entries, "page_id")


# --- Ranked search, vector codes, byte-level BPE ---------------------------------------------

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEXICAL_TERMS = rf"unnest(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"

RANKED_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, text FROM documents),
found AS (SELECT d, term, count(*) AS tf FROM (SELECT d, {_LEXICAL_TERMS} AS term FROM docs) GROUP BY d, term),
lengths AS (SELECT d, CAST(sum(tf) AS BIGINT) AS n FROM found GROUP BY d),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
items AS (SELECT row_number() OVER () AS i, item_id, text FROM benchmark),
asked AS (SELECT i, term, count(*) AS often FROM (SELECT i, {_LEXICAL_TERMS} AS term FROM items) GROUP BY i, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM found, totals WHERE term IN (SELECT term FROM asked) GROUP BY term, docs),
parts AS (SELECT d, term, w * ((1000000000 * tf)
    // (1000 * tf + {ranked.SATURATION} * (100 - {ranked.LENGTH_PERCENT} + ({ranked.LENGTH_PERCENT} * n * docs) // terms))) AS part
  FROM found JOIN weights USING (term) JOIN lengths USING (d), totals),
scored AS (SELECT i, d, CAST(sum(often * part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY i, d),
best AS (SELECT i, doc_id, score,
    CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS "rank"
  FROM scored JOIN docs USING (d) WHERE score > 0)
SELECT item_id, "rank", doc_id, score FROM best JOIN items USING (i) WHERE "rank" <= {ranked.TOP}"""


@query(RANKED_SQL)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _codes_sql() -> str:
    """The rounds one after another, as they are few and their number is fixed."""
    steps = [
        f"""kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, vec_id, label, v FROM (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({codes.SCALE}.0::DOUBLE * x) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))""",
        f"""cut AS (SELECT r, p, list_slice(v, p * len(v) // {codes.PARTS} + 1, (p + 1) * len(v) // {codes.PARTS}) AS x
  FROM kept, range({codes.PARTS}) AS t(p))""",
        f"book0 AS (SELECT p, CAST(r - 1 AS BIGINT) AS e, x FROM cut WHERE r <= {codes.ENTRIES})",
    ]
    gap = "list_sum(list_transform(list_zip(c.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for k in range(codes.ROUNDS + 1):
        steps.append(
            f"""near{k} AS MATERIALIZED (SELECT c.r, c.p, any_value(c.x) AS x,
  min(({gap} * 65536 + b.e)::HUGEINT) AS best FROM cut AS c JOIN book{k} AS b USING (p) GROUP BY c.r, c.p)"""
        )
        if k < codes.ROUNDS:
            steps.append(
                f"""book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{k} AS b LEFT JOIN (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
    SELECT p, e, i, sum(value) AS s, count(*) AS n FROM (
      SELECT p, CAST(best % 65536 AS BIGINT) AS e, unnest(x) AS value, generate_subscripts(x, 1) AS i FROM near{k})
    GROUP BY p, e, i) GROUP BY p, e) AS m ON m.p = b.p AND m.e = b.e)"""
            )
    last = codes.ROUNDS
    steps.append(
        f"""coded AS (SELECT r, string_agg(format('{{:02x}}', CAST(best % 65536 AS BIGINT)), '' ORDER BY p) AS code,
  CAST(sum(best // 65536) AS BIGINT) AS error FROM near{last} GROUP BY r)"""
    )
    steps.append(
        f"""digest AS (SELECT sha256(string_agg(CAST(value AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM (
  SELECT p, e, unnest(x) AS value, generate_subscripts(x, 1) AS i FROM book{last}))"""
    )
    return (
        "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM coded JOIN kept USING (r), digest"""
    )


@query(_codes_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


@query()
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
