"""The registered queries of this subpackage and the DuckDB SQL of those that
SQL can express. Each runs its operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_format, collocations, decontaminate, embedding_dedup, html_extract, importance, jaccard_join, line_dedup, mixing,
               secrets_scan, topk_search, toxicity, warc)
from ..session import scratch_path
from .util import ready, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Distinct five-word shingles (doc_id, g) of a table with an id and a text.
SHINGLES = """
{name}_w AS (SELECT {id}, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM {table}),
{name} AS (SELECT DISTINCT {id}, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM {name}_w)"""


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return register

@query("op1_benchmark_decontamination", f"""
WITH {SHINGLES.format(name="d", id="doc_id", table="documents")}, {SHINGLES.format(name="i", id="item_id", table="benchmark")},
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY 1)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*)::DOUBLE / any_value(n_item) AS containment
FROM d JOIN i USING (g) JOIN n USING (item_id) GROUP BY 1, 2 HAVING count(*)::DOUBLE / any_value(n_item) >= 0.8::DOUBLE""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's shingles."""
    ready(spark)
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, told from examples by who else holds them."""
    ready(spark)
    return secrets_scan.scan(table(spark, sf_dir, "documents"))


@query("op3_exact_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best inner products of every row whose vec_id is divisible by 100."""
    ready(spark)
    v = table(spark, sf_dir, "embeddings")
    return topk_search.search(v, v.where("vec_id % 100 = 0"), 10)


@query("op4_mix_to_targets")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document by a mix of all documents."""
    ready(spark)
    got = mixing.allot(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("places")).cast("long").alias("taken"))


@query("op5_html_extraction")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    ready(spark)
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query("op6_warc_archive", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN last IS NULL OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, read back from a WARC archive of all pages: responses from
    their payloads, revisits from headers alone."""
    ready(spark)
    path = scratch_path(spark, "warc")
    warc.archive(table(spark, sf_dir, "pages"), path)
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    whole = warc.read(spark, path, payload=True).where("record_type = 'response'")
    whole = whole.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    again = warc.read(spark, path).where("record_type = 'revisit'").withColumn("payload_bytes", F.col("payload_length"))
    return whole.select(cols).unionByName(again.select(cols))


@query("op7_chat_format")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, read back from its examples."""
    ready(spark)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-1, n, r, "</s>[INST] ok [/INST]") for n, r in enumerate(("user", "assistant"))],
                                 "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.examples(turns.unionByName(hard)))


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, by a model trained on its labels."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op9_line_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the line chunks that the corpus repeats."""
    ready(spark)
    got = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "text", "n_chars", "n_removed")


@query("op10_ngram_jaccard_join", f"""
WITH RECURSIVE {SHINGLES.format(name="s", id="doc_id", table="documents")},
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y, c = u.n AND c = v.n AS same FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y
  WHERE c::DOUBLE / (u.n + v.n - c) >= 0.8::DOUBLE),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
k AS (SELECT x, min(y) AS m FROM r GROUP BY 1),
g AS (SELECT x, count(*) AS links, count(*) FILTER (WHERE same) AS copies FROM l GROUP BY 1)
SELECT doc_id, least(doc_id, coalesce(m, doc_id)) AS class_id, coalesce(links, 0)::BIGINT AS n_links,
  (coalesce(copies, 0) + 1)::BIGINT AS n_copies
FROM documents LEFT JOIN k ON k.x = doc_id LEFT JOIN g ON g.x = doc_id""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a five-word shingle Jaccard of 0.8 or more."""
    ready(spark)
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


@query("op11_phrase_collocations", r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM w, range(1, 6) r(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
i AS (SELECT lang, array_to_string(ws[s:s + m - 1], ' ') AS phrase, max(a) AS longer
  FROM c, range(2, 5) mm(m), range(1, 5) ss(s) WHERE m < k AND s + m - 1 <= k GROUP BY 1, 2),
o AS (SELECT c.* FROM c LEFT JOIN i ON i.lang = c.lang AND i.phrase = c.phrase WHERE i.longer IS NULL OR 100 * i.longer < 100 * c.a),
u AS (SELECT o.lang, o.phrase, o.a, x.a AS l, y.a AS r, t.n, cut, ((1000::HUGEINT * o.a * t.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM o JOIN range(1, 5) cc(cut) ON cut < o.k JOIN t ON t.lang = o.lang
  JOIN f x ON x.lang = o.lang AND x.phrase = array_to_string(o.ws[1:cut], ' ')
  JOIN f y ON y.lang = o.lang AND y.phrase = array_to_string(o.ws[cut + 1:o.k], ' ')),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b QUALIFY rank <= 2000""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 phrases of each language whose words stick together best."""
    ready(spark)
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op12_importance_resampling")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's distribution, and the draw."""
    ready(spark)
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_embedding_near_dedup", """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) / (a.norm * b.norm) >= 0.95::DOUBLE),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
k AS (SELECT x, min(y) AS m FROM r GROUP BY 1),
g AS (SELECT x, count(*) AS links FROM l GROUP BY 1)
SELECT vec_id, coalesce(links, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN k ON k.x = vec_id LEFT JOIN g ON g.x = vec_id""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with a cosine of 0.95 or more, and what they connect."""
    ready(spark)
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
