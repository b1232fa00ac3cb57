"""The registered queries of the text operators, each with the SQL it is checked against where SQL can say it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per session: they need not have it installed or share a folder."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(prefix="txnlens-code-"), f"{package.name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(spark.sparkContext.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document."""
    from txnlens.llm.quality_classifier import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_quartile_fingerprints")
def op2_quartile_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of an edit of it, and how near they are."""
    from txnlens.llm.fingerprints import fingerprint_neighbours

    return fingerprint_neighbours(table(spark, sf_dir, "documents"))


@query("op3_mix_sources", rf"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sizes GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][place % 3 + 1] AS w FROM per),
shared AS (
  SELECT *, (150.0::DOUBLE * sum(source_size) OVER () / 100
      - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY source_size / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM weighed),
level AS (SELECT arg_min(share, (source_size / w, place)) AS share FROM shared WHERE 2.0::DOUBLE * source_size >= share * w),
goals AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, level.share * w) AS target FROM shared, level),
needs AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM goals),
runs AS (
  SELECT n.source, h, words, target - copies * source_size AS need,
    sum(words) OVER (PARTITION BY n.source ORDER BY h) AS upto
  FROM needs n JOIN (SELECT source, h, sum(size) AS words FROM sizes GROUP BY ALL) s ON n.source IS NOT DISTINCT FROM s.source),
edges AS (
  SELECT source, min(h) AS h, arg_min(CASE WHEN upto - need < need - (upto - words) THEN 1 ELSE 0 END, h) AS take
  FROM runs WHERE upto > need GROUP BY source)
SELECT d.doc_id, d.size, n.source_size, n.target,
  CAST((n.copies + CASE WHEN d.h < coalesce(e.h + e.take, 0) THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken
FROM sizes d JOIN needs n ON d.source IS NOT DISTINCT FROM n.source
LEFT JOIN edges e ON d.source IS NOT DISTINCT FROM e.source""")
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of the sources takes from each document."""
    from txnlens.llm.mixture import mix

    return mix(table(spark, sf_dir, "documents")).drop("copies")


@query("op4_minhash_dedup", rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT w.doc_id, CAST(coalesce(any_value(s.n), 0) AS BIGINT) AS n_shingles,
  least(w.doc_id, coalesce(min(r.v), w.doc_id)) AS component_id,
  w.doc_id = least(w.doc_id, coalesce(min(r.v), w.doc_id)) AS kept
FROM words w LEFT JOIN sizes s USING (doc_id) LEFT JOIN reach r ON r.u = w.doc_id GROUP BY w.doc_id""")
def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of the documents."""
    from txnlens.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def _license_sql() -> str:
    from txnlens.llm.license_scan import TEMPLATES, template_words, window_size

    rows = ", ".join(f"('{name}', {template_words(t)}, {window_size(len(template_words(t)))})" for name, t in TEMPLATES.items())
    return f"""
WITH templates(license, tw, size) AS (VALUES {rows}),
known AS (
  SELECT license, size, list_distinct([array_to_string(tw[i:i + 2], ' ') for i in range(1, len(tw) - 1)]) AS t FROM templates),
words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
shingles AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
wanted AS (SELECT license, size, len(t) AS n, unnest(t) AS s FROM known),
hits AS (
  SELECT doc_id, license, n, start, count(DISTINCT s) AS c FROM (
    SELECT doc_id, license, n, size, s, p, (p // (size // 2) - back) * (size // 2) AS start
    FROM shingles JOIN wanted USING (s), (VALUES (0), (1)) b(back))
  WHERE start >= 0 AND p + 2 < start + size GROUP BY ALL)
SELECT doc_id, license, max(c / n) AS containment, min(start) AS first_word, count(*) AS n_windows
FROM hits WHERE c / n >= 0.8 GROUP BY doc_id, license"""


@query("op5_license_scan", _license_sql())
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in the documents."""
    from txnlens.llm.license_scan import license_matches

    return license_matches(table(spark, sf_dir, "documents"))


@query("op6_weak_toxicity")
def op6_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document."""
    from txnlens.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_best_two_fit")
def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of the tokenised documents goes."""
    import public_tokenizers

    from txnlens.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op8_warc_bundles", """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM m""")
def op8_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages say when they are read back."""
    from txnlens.llm.warc import archive_pages, read_archives

    return read_archives(*archive_pages(table(spark, sf_dir, "pages"))).drop("payload")


@query("op9_substring_dedup", rf"""
WITH words AS (SELECT doc_id, {WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)),
hits AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 35)))) AS cut
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM windows) WHERE n > 1 GROUP BY doc_id),
kept AS (
  SELECT doc_id, w, CASE WHEN cut IS NULL THEN w ELSE
    [x.v for x in list_zip(w, range(1, len(w) + 1)).list_transform(lambda p: {{'v': p[1], 'i': p[2]}}) if NOT list_contains(cut, x.i)] END AS k
  FROM words LEFT JOIN hits USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(k) AS BIGINT) AS n_removed,
  sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept""")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without passages of 35 words that start more than once."""
    from pyspark.sql import functions as F

    from txnlens.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the learnt decision list's verdict for each document."""
    from txnlens.llm.quality_rules import COUNTS, apply_rules

    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", *COUNTS, "base_failed", "kept", "rule")


@query("op11_length_strata_search", r"""
WITH terms AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
whole AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_all FROM terms WHERE len(t) > 0),
normal AS (SELECT r, doc_id, t, 10 + (90 * CAST(len(t) AS BIGINT) * n_docs) // n_all AS m FROM terms, whole WHERE len(t) > 0),
postings AS (SELECT r, doc_id, m, term, count(*) AS tf FROM (SELECT r, doc_id, m, unnest(t) AS term FROM normal) GROUP BY ALL),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM postings, whole GROUP BY term, n_docs),
scores AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN postings USING (term) GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) <= 10""")
def op11_length_strata_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    from txnlens.llm.lexical_search import search_documents

    return search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Words one edit apart have a deletion of one of them, or the same letters but for one place, in common: both as patterns.
@query("op13_spelling_variants", """
WITH RECURSIVE runs AS (
  SELECT id, run, count(*) AS c FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL),
bits AS (SELECT run, c, bin(id || ':' || run) AS b FROM runs),
hashes AS (
  SELECT run, c, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT,
      [CAST(b[8 * (i // 8) + 8 - i % 8] AS UBIGINT) for i in range(0, length(b))]),
    lambda s, x: CASE WHEN xor(s, x) % 2 = 1 THEN xor(s // 2, 3988292384::UBIGINT) ELSE s // 2 END)) AS h FROM bits),
words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT c, CASE WHEN h % 97 = 0 THEN run[:CAST(h % length(run) AS BIGINT)] || run[CAST(h % length(run) AS BIGINT) + 2:] ELSE run END AS word
    FROM hashes) WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
holes AS (SELECT word, n, i, word[:i - 1] AS a, word[i + 1:] AS z FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM holes x JOIN holes y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON h.a || h.z = w.word
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON h.a || h.z = w.word),
best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, encode(near))) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
known AS (
  SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form,
    CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (
  SELECT word, word AS at, form AS next FROM known
  UNION ALL SELECT c.word, k.word, k.form FROM chain c JOIN known k ON c.next = k.word)
SELECT k.word, k.form, c.at AS root, k.n, k.n_near, k.form_n FROM known k JOIN chain c ON c.word = k.word AND c.next IS NULL""")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every counted word with its more frequent form and root."""
    from txnlens.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


@query("op12_secret_scan")
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document holds secrets."""
    from txnlens.llm.secret_scan import secret_digests

    return secret_digests(table(spark, sf_dir, "documents"))
