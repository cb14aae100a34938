"""The queries of this subpackage, as ``QUERIES`` and, where SQL can express them, ``ORACLE_SQL``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_fold(id_col: str, folds: int, fold: int) -> Column:
    """Whether the crc32 of the id as text leaves this remainder; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC capture and read back, the records assembled into transactions."""
    from . import warc
    from .shelf import Shelf

    shelf = Shelf(spark, "warc")
    path = shelf.place()
    warc.write(table(spark, sf_dir, "pages"), path)
    rows = shelf.put(warc.records(spark, path).drop("payload"))  # the archives are read once; transactions() takes the records twice
    rows = warc.transactions(rows).where("response is not null")
    fields = F.col("metadata")[0]["fields"]
    return rows.select(
        fields["page-id"].cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        fields["refers-to-page-id"].cast("long").alias("refers_to"),
    )


def op3_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known licence sentences of every document, in order, and the licences whose rules they fulfil."""
    from . import licenses

    found = licenses.recognise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.size("sentence_ids").cast("long").alias("n_known"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("license_ids", ",").alias("license_ids")
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and the digest of what they decode to."""
    return bpe_digests(table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    from . import bpe

    ids = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_decoded=True)
    return ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_piece_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from three quarters of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    found = language(docs.select("doc_id", "text", "lang"))
    return found.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def language(docs: DataFrame) -> DataFrame:
    """docs with lang_pred and score, learned from their own labels outside of the held-out fold."""
    import public_tokenizers

    from . import langid

    model = langid.fit(docs.where(~in_fold("doc_id", 4, 2)), public_tokenizers.path("piece_bpe_32k.model"))
    return langid.predict(docs, model)


def op5_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from . import html

    return html.extract(table(spark, sf_dir, "pages"))


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, written to indexed shards in order of doc_id and read back."""
    import public_tokenizers

    from . import tokenfile
    from .shelf import Shelf

    shelf = Shelf(spark, "ids")
    path = shelf.place()
    tokenfile.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    rows = shelf.put(tokenfile.read(spark, path))
    return tokenfile.layout(rows).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op7_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    from . import ann

    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every whole text under a model of six sevenths of the texts."""
    from . import lm

    scored = lm.score(table(spark, sf_dir, "documents"), ~in_fold("doc_id", 7, 2))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items that overlap, substitutions allowed for."""
    from . import decontaminate

    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_minhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have similarity 0.8 or more."""
    from . import near

    return near.near_duplicates(table(spark, sf_dir, "documents"), k=4)


#: A-Z to lower case, and no other letters.
SQL_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP10_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce({SQL_LOWER}, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS s
  FROM w
), sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS d, doc_id AS r FROM documents
  UNION
  SELECT reach.d, links.b FROM reach JOIN links ON links.a = reach.r
)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least_id AS component_id, sets.doc_id = least_id AS kept
FROM sets JOIN (SELECT d, min(r) AS least_id FROM reach GROUP BY d) ON d = sets.doc_id
"""

OP1_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest, row_number() OVER () AS i FROM pages),
g AS (SELECT digest, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN g ON p.digest = g.digest
"""


def _op3_sql() -> str:
    from . import licenses

    known = ", ".join(f"('{s}', '{i}')" for s, i in licenses.KNOWN.items())
    rules = ", ".join(f"('{n}', ' {' '.join(ids)} ')" for n, ids in licenses.RULES)
    normal = "trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"
    ends = "regexp_replace({}, '([.!?:])[ \\t\\n\\r]+', '\\1' || chr(1), 'g')"
    cuts = {
        "by_line": f"string_split(regexp_replace({ends.format('coalesce(text, chr(32))')}, '[\\n\\r]+', chr(1), 'g'), chr(1))",
        "joined": f"string_split({ends.format('coalesce(text, chr(32))')}, chr(1))",
    }
    parts = []
    for name, cut in cuts.items():
        parts.append(f"{name}_s AS (SELECT doc_id, unnest(c) AS s, unnest(range(len(c))) AS i FROM (SELECT doc_id, {cut} AS c FROM documents))")
        parts.append(f"{name} AS (SELECT doc_id, count(*) AS n, string_agg(id, ' ' ORDER BY i) AS q FROM {name}_s JOIN known ON known.s = {normal.replace('(s,', f'({name}_s.s,')} GROUP BY doc_id)")
    return f"""
WITH known(s, id) AS (VALUES {known}), rules(license, q) AS (VALUES {rules}), {", ".join(parts)},
d AS (
  SELECT documents.doc_id, coalesce(by_line.n, 0) AS nl, coalesce(joined.n, 0) AS nj, coalesce(by_line.q, '') AS ql, coalesce(joined.q, '') AS qj
  FROM documents LEFT JOIN by_line USING (doc_id) LEFT JOIN joined USING (doc_id)
), hold AS (
  SELECT DISTINCT doc_id, license FROM d JOIN rules ON contains(' ' || ql || ' ', rules.q) OR contains(' ' || qj || ' ', rules.q)
), named AS (
  SELECT doc_id, string_agg(license, ',' ORDER BY license) AS ids FROM hold h
  WHERE NOT (license = 'BSD-2-Clause' AND EXISTS (SELECT 1 FROM hold w WHERE w.doc_id = h.doc_id AND w.license = 'BSD-3-Clause')) GROUP BY doc_id
)
SELECT d.doc_id, CAST(greatest(nl, nj) AS BIGINT) AS n_known, replace(CASE WHEN nj > nl THEN qj ELSE ql END, ' ', ',') AS sentence_ids, coalesce(ids, '') AS license_ids
FROM d LEFT JOIN named USING (doc_id)
"""


OP7_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_license_rules": op3_license_rules,
    "op4_piece_language": op4_piece_language,
    "op5_html_wrappers": op5_html_wrappers,
    "op6_token_file": op6_token_file,
    "op7_additive_ann": op7_additive_ann,
    "op8_backoff_lm": op8_backoff_lm,
    "op9_spaced_seeds": op9_spaced_seeds,
    "op10_minhash_near": op10_minhash_near,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op3_license_rules": _op3_sql(),
    "op7_additive_ann": OP7_SQL,
    "op10_minhash_near": OP10_SQL,
}
