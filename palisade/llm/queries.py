"""Registered queries of this package: one for each operator, over its whole table, and the pipeline."""

from pyspark.sql import functions as F

from palisade.llm import bpe, divergence, exact_dedup, licenses, mixing, ngram_join, quality, secrets, sketch, spelling, token_files, url_filter, warc
from palisade.llm.common import n_words, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark, sf_dir):
            from palisade import ship

            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_ngram_join")
def op1(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


@query("op2_secrets")
def op2(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(F.encode(secrets.render(base), "UTF-8"), 256).alias("base_sha256"),
        secrets.render(F.col("spans")).alias("spans"),
    )


@query("op3_licenses")
def op3(spark, sf_dir):
    found = licenses.scan(table(spark, sf_dir, "documents"))
    labels = F.array_sort(F.array_distinct(F.col("places.label")))
    starts = F.col("places.start")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(labels, F.col("found"))), ",").alias("labels"), "score",
    )


@query("op4_quality")
def op4(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.classify(docs, labels, F.col("source"), F.col("lang"))


@query("op5_mixing")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, "doc_id", n_words(F.coalesce("text", F.lit(""))), F.array("source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"), "n_copies")


@query("op6_bpe")
def op6(spark, sf_dir):
    spec = bpe.tokenizer_spec()
    decoded = bpe.encode(table(spark, sf_dir, "documents"), spec, decoded=True)
    n = (F.octet_length("ids") / 4).cast("bigint")
    return decoded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


#: The rules of the contract.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query(
    "op7_url_filter",
    r"""WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.v, length(r.h || r.p)) AS v
      FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)""",
)
def op7(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


@query(
    "op8_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
)
def op8(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


@query(
    "op9_warc",
    """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to FROM f""",
)
def op9(spark, sf_dir):
    from palisade.plans.stage import scratch_path

    path = scratch_path(spark, "warc")
    warc.write_archives(warc.records(table(spark, sf_dir, "pages")), path)
    return warc.resolve(warc.read_archives(spark, path))


@query("op10_sketch")
def op10(spark, sf_dir):
    return sketch.fingerprints(table(spark, sf_dir, "documents"))


@query("op11_token_files")
def op11(spark, sf_dir):
    return token_files.round_trip(table(spark, sf_dir, "documents"))


@query(
    "op12_divergence",
    r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT g.lang, g.source, coalesce(sum(c.n) FILTER (k.term IS NOT NULL), 0)::HUGEINT AS n
      FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source LEFT JOIN k ON k.lang = c.lang AND k.term = c.term GROUP BY ALL),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT) // (t.n + v.v))::BIGINT AS p,
        (1 + (1000000000 * (k.n + 1)) // (v.n + v.v))::BIGINT AS q
      FROM t JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200""",
)
def op12(spark, sf_dir):
    return divergence.divergence(table(spark, sf_dir, "documents"))


@query("op13_spelling")
def op13(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))
