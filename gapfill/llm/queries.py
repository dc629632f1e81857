"""Queries of the pipeline operators and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import functions as F

from gapfill.frames import checkpoint_dir
from gapfill.llm import pieces, quality, toxicity
from gapfill.llm.decontaminate import contamination
from gapfill.llm.langid import identify, train
from gapfill.llm.lexical import search
from gapfill.llm.minhash import near_duplicates
from gapfill.llm.negatives import mine
from gapfill.llm.packing import pack
from gapfill.llm.shards import materialise
from gapfill.llm.substring import repeated_passages
from gapfill.llm.topk import top_k
from gapfill.llm.urlfilter import SOFT, SOFT_LIMIT, STRICT, filter_urls

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; without ``sql`` its tests compare with a brute-force version."""
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op6_minmax_near_duplicates", f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({LOWER.format('text')}, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""")
def op6(spark, d):
    """Near-duplicate components of whole documents at a similarity of 0.85."""
    return near_duplicates(table(spark, d, "documents"))


RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
         ("block", "com", "/de/"))
_FOUND = "regexp_matches({0}, '(^|[^a-z0-9])' || t || '($|[^a-z0-9])')".format(LOWER.format("url"))


@query("op2_url_filter", f"""
WITH terms(t, w) AS (VALUES {', '.join([f"('{t}', 0.0)" for t in STRICT] + [f"('{t}', {w})" for t, w in SOFT.items()])}),
rules(kind, h, p) AS (VALUES {', '.join(f"('{k}', '{h}', '{p}')" for k, h, p in RULES)}),
hits AS (SELECT page_id, count(*) FILTER (WHERE w = 0) AS n_strict, count(*) FILTER (WHERE w > 0) AS n_soft, sum(w) AS weight
         FROM pages, terms WHERE {_FOUND} GROUP BY page_id),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
s AS (SELECT page_id, {LOWER.format("regexp_extract(r, '^([^/?#]*)', 1)")} AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT page_id, first(h || p ORDER BY length(h || p) DESC) AS rule, first(kind ORDER BY length(h || p) DESC) AS kind
      FROM s, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(kind, CASE WHEN n_strict > 0 OR weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(n_strict, 0)::int AS n_strict, coalesce(n_soft, 0)::int AS n_soft, coalesce(weight, 0)::double AS weight
FROM s LEFT JOIN f USING (page_id) LEFT JOIN hits USING (page_id)""")
def op2(spark, d):
    """Verdict of every page's URL."""
    return filter_urls(table(spark, d, "pages"), RULES)


@query("op3_language_id")
def op3(spark, d):
    """Language of every whole document, learned outside the held-out fold."""
    docs = table(spark, d, "documents")
    return identify(docs, train(docs))


_ALNUM = "regexp_extract_all(coalesce({0}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(LOWER.format("text"))


@query("op8_decontaminate", f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
      FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, k.n, item_id FROM k JOIN g USING (n, g)),
p AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM h) GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items FROM (SELECT DISTINCT doc_id, item_id::varchar AS x FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items, sha256('')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)""")
def op8(spark, d):
    """Benchmark windows in every whole document."""
    return contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op4_norm_bucket_topk", """
WITH v AS (SELECT vec_id, [floor(1024 * x::double)::bigint FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)])::bigint AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def op4(spark, d):
    """Ten highest inner products of every hundredth vector."""
    return top_k(table(spark, d, "embeddings"))


@query("op5_training_order_shards")
def op5(spark, d):
    """Shards of all documents in a permuted order; the place of every sequence."""
    return materialise(table(spark, d, "documents"), f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}")


@query("op10_lp_packing")
def op10(spark, d):
    """All documents packed into sequences of 2048 tokens."""
    return pack(table(spark, d, "documents"))


@query("op9_pairwise_quality")
def op9(spark, d):
    """Quality of every whole document, learned outside the held-out fold."""
    docs = table(spark, d, "documents")
    return quality.score(docs, quality.train(docs, table(spark, d, "labels")))


@query("op1_toxicity")
def op1(spark, d):
    """Toxicity of every whole document, learned outside the held-out fold."""
    docs = table(spark, d, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, d, "labels")))


@query("op7_compact_windows")
def op7(spark, d):
    """Passages of 50 words or more that stand near-equal in an earlier document."""
    return repeated_passages(table(spark, d, "documents"))


@query("op12_sentencepiece")
def op12(spark, d):
    """Ids of every whole document and the text they spell, as digests."""
    out = pieces.decode(pieces.encode(table(spark, d, "documents")))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


_TERMS = "regexp_extract_all(coalesce({0}, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')".format(LOWER.format("text"))


@query("op13_max_sketch_search", f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents), b AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::bigint AS n_terms FROM d),
f AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) SEMI JOIN b USING (t) GROUP BY doc_id, n, t),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint AS w FROM f, s GROUP BY t, n_docs),
i AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))) AS i FROM f JOIN w USING (t), s),
r AS (SELECT item_id, doc_id, sum(i)::bigint AS score FROM b JOIN i USING (t) GROUP BY item_id, doc_id HAVING sum(i) > 0)
SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank, doc_id, score FROM r) WHERE rank <= 10""")
def op13(spark, d):
    """Ten best documents of every benchmark item."""
    return search(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op11_hard_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::double)::bigint FOR x IN embedding] AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
           AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, list_sum([p[1] * p[2] FOR p IN list_zip(a.v, c.v)])::bigint AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE alike) WHERE r <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::int AS rank,
             s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT * FROM n WHERE rank <= 10""")
def op11(spark, d):
    """Hard negatives of every hundredth vector; every seventh label is moved on by one."""
    moved = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return mine(table(spark, d, "embeddings").withColumn("label", moved))
