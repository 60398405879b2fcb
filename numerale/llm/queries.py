"""One query per operator, over its whole table, and the SQL it is checked with where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from numerale.llm import context_tree, decontaminate, embedding_dedup, language, lexical_search, line_dedup, manifest, packing, pii, quality, simhash, vector_search, warc
from numerale.llm.common import crc_mod, load

#: The query's key; a user passes one of their own and keeps it.
PII_KEY = b"numerale catalogue"


def op1_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf, "documents"), shingle=4, max_bits=4)
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), "component_id")


def op2_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    found = embedding_dedup.near_duplicates(load(spark, sf, "embeddings"), min_cosine=0.95)
    return found.withColumnRenamed("id", "vec_id")


def op3_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = line_dedup.remove_repeated_lines(load(spark, sf, "documents"))
    return out.select("doc_id", "text", "lines_removed")


def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    labels = load(spark, sf, "labels").where(crc_mod("doc_id", 5) != 0)
    out = quality.scored(docs.select("doc_id", "text"), quality.learn(docs, labels))
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", predicted)


def op5_context_tree(spark: SparkSession, sf: str) -> DataFrame:
    out = context_tree.scored(load(spark, sf, "documents"), crc_mod("doc_id", 5) != 1)
    out = out.withColumnRenamed("id", "doc_id").withColumn("held_out", ~F.col("learned"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op6_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archived(load(spark, sf, "pages"), min_revisit=0).drop("intact")


def op7_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    model = language.learn(docs.where(crc_mod("doc_id", 4) != 2))
    out = language.identified(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    out = pii.pseudonymized(load(spark, sf, "documents").select("doc_id", "text"), PII_KEY)
    return out.select("doc_id", "text", "n_replaced")


def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(load(spark, sf, "documents"))


def op10_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(load(spark, sf, "documents"), load(spark, sf, "benchmark"))


def op11_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    found = lexical_search.ranked_search(load(spark, sf, "documents"), load(spark, sf, "benchmark"), k=10)
    return found.withColumnRenamed("id", "doc_id")


def op12_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    found = vector_search.top_k(load(spark, sf, "embeddings"), F.col("id") % 100 == 0, k=10)
    return found.withColumnRenamed("id", "vec_id")


def op13_manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = {"n_chars": F.col("n_chars") + F.when(struck, 1).otherwise(0)}
    found = manifest.manifest(docs, "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"], tampered)
    return manifest.verified(found).withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_embeddings": op2_embeddings,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality": op4_quality,
    "op5_context_tree": op5_context_tree,
    "op6_warc": op6_warc,
    "op7_language": op7_language,
    "op8_surrogates": op8_surrogates,
    "op9_packing": op9_packing,
    "op10_decontamination": op10_decontamination,
    "op11_ranked_search": op11_ranked_search,
    "op12_exact_top_k": op12_exact_top_k,
    "op13_manifest": op13_manifest,
}


#: Written archives are files; what they give back is known from the pages alone.
WARC_SQL = """
WITH d AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, sha1(t) AS x FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x, payload_bytes) AS first FROM h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH_SQL = f"""
WITH words AS (SELECT doc_id, row, unnest({_TERMS}) AS t FROM (SELECT *, row_number() OVER () AS row FROM documents)),
tf AS (SELECT row, doc_id, t, count(*) AS tf FROM words GROUP BY ALL),
size AS (SELECT row, sum(tf) AS n FROM tf GROUP BY row),
totals AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM size),
weights AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(nn) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY t),
asked AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL),
found AS (
  SELECT item_id, doc_id, row, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * CAST(n AS BIGINT) * nn) // ll)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (t) JOIN tf USING (t) JOIN size USING (row), totals GROUP BY ALL),
placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM found WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10"""

TOP_K_SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 10"""


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


def _nodes(name: str, leaves: str) -> str:
    """All nodes of the binary trees over ``leaves`` (g, pos, n, h), level by level."""
    return f"""{name} AS (
  SELECT g, 0 AS lvl, pos, n, h FROM {leaves}
  UNION ALL
  SELECT g, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY g, lvl, pos // 2, n)"""


MANIFEST_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('v' || lang, '') AS g,
         sha256({" || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
         sha256({" || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars + hit", "text"))}) AS seen
  FROM (SELECT *, CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
          lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS hit
        FROM documents)),
placed AS (
  SELECT *, leaf AS h, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM docs),
{_nodes("low", "placed")},
subroots AS (
  SELECT g AS own, '' AS g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
{_nodes("high", "subroots")},
ways AS (
  SELECT p.doc_id, p.g, p.pos, a.lvl, CASE WHEN (p.pos >> a.lvl) % 2 = 1 THEN b.h ELSE '' END AS l, CASE WHEN (p.pos >> a.lvl) % 2 = 0 THEN coalesce(b.h, '') ELSE '' END AS r
  FROM placed p JOIN low a ON a.g = p.g AND a.pos = p.pos >> a.lvl AND a.n > 1
  LEFT JOIN low b ON b.g = a.g AND b.lvl = a.lvl AND b.pos = xor(a.pos, 1)
  UNION ALL
  SELECT p.doc_id, p.g, p.pos, 1000 + a.lvl, CASE WHEN (s.pos >> a.lvl) % 2 = 1 THEN b.h ELSE '' END, CASE WHEN (s.pos >> a.lvl) % 2 = 0 THEN coalesce(b.h, '') ELSE '' END
  FROM placed p JOIN subroots s ON s.own = p.g JOIN high a ON a.pos = s.pos >> a.lvl AND a.n > 1
  LEFT JOIN high b ON b.lvl = a.lvl AND b.pos = xor(a.pos, 1)),
proofs AS (
  SELECT g, pos, list(struct_pack(l := l, r := r) ORDER BY lvl) AS way, sha256(string_agg(l || r, '' ORDER BY lvl)) AS proof FROM ways GROUP BY g, pos),
found AS (
  SELECT p.doc_id, p.leaf, s.h AS subroot, t.h AS root, coalesce(w.proof, sha256('')) AS proof_sha256,
         list_reduce(list_prepend(struct_pack(l := p.seen, r := ''), coalesce(w.way, [])), lambda a, x: struct_pack(l := sha256(x.l || a.l || x.r), r := '')).l AS folded_root
  FROM placed p JOIN subroots s ON s.own = p.g CROSS JOIN (SELECT h FROM high WHERE n = 1) t LEFT JOIN proofs w ON w.g = p.g AND w.pos = p.pos)
SELECT *, folded_root = root AS verified FROM found"""


def oracle() -> dict[str, str]:
    """The other operators hash, learn or tokenize: SQL can't express them, or only as all pairs; see tests/llm."""
    return {"op6_warc": WARC_SQL, "op11_ranked_search": SEARCH_SQL, "op12_exact_top_k": TOP_K_SQL, "op13_manifest": MANIFEST_SQL}
