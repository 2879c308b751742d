"""The registered queries of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrail.llm import coalitions, decontaminate, divergence, extraction, jaccard, lines, mixing, quality, repeats, secrets, sharding, urls, vectors
from sigtrail.llm.scratch import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op10_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.shard(docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")))), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


MIXTURE = mixing.Mixture(
    weights={
        ("web",): 5, ("books",): 3, ("code",): 2,
        ("web", "en"): 6, ("web", "de"): 2, ("web", "fr"): 2, ("web", "es"): 2,
        ("books", "en"): 3, ("code", "en"): 4,
        ("web", "en", "src0"): 4,
    }
)


def domain() -> Column:
    """The domain of a source: the corpus has no such column."""
    web, books = [f"src{i}" for i in range(10)], [f"src{i}" for i in range(10, 15)]
    return F.when(F.col("source").isin(web), "web").when(F.col("source").isin(books), "books").otherwise("code")


@query
def op1_hierarchical_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a mixture of 60 % of all tokens, by domain, language and source."""
    chosen = mixing.mix(table(spark, sf_dir, "documents"), MIXTURE, domain())
    return chosen.select("doc_id", "epoch", "domain", "lang", "source", "n_tokens")


def _weight_sql(depth: int) -> str:
    cases = [
        "WHEN " + " AND ".join(f"{level} = '{name}'" for level, name in zip(("d", "l", "s"), path)) + f" THEN {w}"
        for path, w in MIXTURE.weights.items() if len(path) == depth
    ]
    return f"CASE {' '.join(cases)} ELSE 1 END"


def _level_sql(depth: int) -> str:
    keys, up = ", ".join("dls"[:depth]), ", ".join("dls"[: depth - 1])
    part = f"PARTITION BY {up}" if up else ""
    above = f"JOIN (SELECT {up}, budget FROM t{depth - 1}) USING ({up})" if up else "CROSS JOIN t0"
    return f"""
n{depth} AS (SELECT {keys}, cap, tokens, budget, {_weight_sql(depth)} AS w
  FROM (SELECT {keys}, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * {MIXTURE.max_epochs} AS cap FROM leaves GROUP BY {keys}) {above}),
f{depth} AS (SELECT *, (budget - coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w
    >= cap * sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_full
  FROM n{depth} WINDOW r AS ({part} ORDER BY cap / w::DOUBLE, {keys})),
g{depth} AS (SELECT *, coalesce(sum(cap) FILTER (is_full) OVER ({part}), 0) AS used, coalesce(sum(w) FILTER (NOT is_full) OVER ({part}), 0) AS open_w FROM f{depth}),
t{depth} AS (SELECT {keys}, tokens, CASE WHEN is_full THEN cap ELSE (budget - used) * w // greatest(open_w, 1) END AS budget FROM g{depth})"""


SQL["op1_hierarchical_mixture"] = (
    f"""
WITH docs AS (
  SELECT doc_id, lang, source, coalesce(lang, '') AS l, coalesce(source, '') AS s, coalesce(text, '') AS text,
    CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'web' WHEN regexp_matches(source, '^src1[0-4]$') THEN 'books' ELSE 'code' END AS d,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens
  FROM documents),
leaves AS (SELECT d, l, s, sum(n_tokens) AS tokens FROM docs GROUP BY d, l, s),
t0 AS (SELECT sum(tokens)::BIGINT * {MIXTURE.percent} // 100 AS budget FROM leaves),"""
    + ",".join(_level_sql(depth) for depth in (1, 2, 3))
    + f""",
keyed AS (
  SELECT docs.*, budget // greatest(tokens, 1) AS whole, budget % greatest(tokens, 1) AS rest,
    ('0x' || substr(md5('{MIXTURE.seed}:' || (budget // greatest(tokens, 1))::BIGINT || ':' || coalesce(doc_id::VARCHAR, '') || ':' || md5(text)), 1, 15))::BIGINT AS k
  FROM docs JOIN t3 USING (d, l, s)),
places AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY d, l, s ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up_to,
    sum(n_tokens) OVER (PARTITION BY d, l, s, k) AS here FROM keyed),
used AS (SELECT *, whole + CASE WHEN rest > 0 AND 2 * up_to - here <= 2 * rest THEN 1 ELSE 0 END AS epochs FROM places)
SELECT doc_id, e AS epoch, d AS domain, lang, source, n_tokens::BIGINT AS n_tokens
FROM used, LATERAL (SELECT unnest(range(0, epochs::BIGINT)) AS e)"""
)


@query
def op3_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every benchmark item that it contains."""
    found = decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), "item_id", F.col("n_shared").cast("long").alias("n_shared"), F.col("n_item").cast("long").alias("n_item"))


def _shingle_sql(name: str, rows: str, key: str, k: int) -> str:
    """(key, shingle): the distinct k-word shingles; a shorter text is one shingle."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""{name}_w AS (SELECT {key}, regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM {rows}),
{name} AS (SELECT DISTINCT {key}, array_to_string(w[i : i + {k - 1}], ' ') AS shingle
  FROM {name}_w, LATERAL (SELECT unnest(range(1, greatest(len(w) - {k - 2}, 2))) AS i) WHERE len(w) > 0)"""


SQL["op3_minhash_containment"] = f"""
WITH {_shingle_sql("doc", "documents", "doc_id", 5)},
{_shingle_sql("item", "benchmark", "item_id", 5)},
sized AS (SELECT item_id, count(*) AS n_item FROM item GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM doc JOIN item USING (shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item FROM shared JOIN sized USING (item_id) WHERE 5 * n_shared >= 4 * n_item"""


@query
def op6_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, chain)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op4_adaptive_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near copies (3-word shingles, similarity 0.9) of every document."""
    return jaccard.near_classes(table(spark, sf_dir, "documents"), jaccard.Similarity(k=3, numerator=90))


SQL["op4_adaptive_prefix_join"] = f"""
WITH RECURSIVE {_shingle_sql("doc", "documents", "doc_id", 3)},
sized AS (SELECT doc_id, count(*) AS n FROM doc GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM doc a JOIN doc b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(max(n), 0) AS n_shingles, min(reach.b) AS component_id
FROM documents d LEFT JOIN sized ON sized.doc_id = d.doc_id JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id"""


@query
def op9_trigram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@query
def op8_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near copies (cosine 0.98 within a label) of every embedding."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


SQL["op8_metric_range_join"] = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""


@query
def op7_inferred_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extraction.extract(table(spark, sf_dir, "pages"))


URL_RULES = [
    urls.Rule("block", "net", "/"),
    urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
]


@query
def op5_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))


@query
def op2_deletion_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated and nearly repeated lines."""
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_kept", F.md5("text").alias("text_md5"))


SQL["op2_deletion_neighbourhood"] = """
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
occ AS (SELECT doc_id, i, l[i] AS line FROM parts, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)),
ranked AS (SELECT doc_id, i, line, row_number() OVER (ORDER BY doc_id, i) AS place FROM occ WHERE trim(line, ' ') <> ''),
firsts AS (SELECT line, min(place) AS place, length(line) AS n FROM ranked GROUP BY line),
near AS (
  SELECT DISTINCT b.line FROM firsts a JOIN firsts b ON a.place < b.place AND abs(a.n - b.n) <= 1 AND least(a.n, b.n) >= 16
    AND (left(a.line, least(a.n, b.n) // 2) = left(b.line, least(a.n, b.n) // 2)
      OR right(a.line, least(a.n, b.n) - least(a.n, b.n) // 2) = right(b.line, least(a.n, b.n) - least(a.n, b.n) // 2))
  WHERE a.n BETWEEN b.n - 1 AND b.n + 1 AND levenshtein(a.line, b.line) <= 1),
kept AS (
  SELECT occ.doc_id, occ.i, occ.line FROM occ LEFT JOIN ranked USING (doc_id, i) LEFT JOIN firsts ON firsts.line = occ.line AND firsts.place = ranked.place
  WHERE ranked.place IS NULL OR (firsts.place IS NOT NULL AND occ.line NOT IN (SELECT line FROM near)))
SELECT doc_id, len(l)::BIGINT AS n_lines, count(kept.i) AS n_kept, md5(coalesce(string_agg(kept.line, chr(10) ORDER BY kept.i), '')) AS text_md5
FROM parts LEFT JOIN kept USING (doc_id) GROUP BY doc_id, l"""


@query
def op11_coalition_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters does at every step of all 120 orders, by language."""
    docs, conditions = coalitions.text_filters(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return coalitions.audit(docs, conditions, F.coalesce("lang", F.lit("")), table(spark, sf_dir, "labels"), copies="E")


def _bit(letter: str) -> str:
    return f"(1 << (instr('ABCDE', {letter}) - 1))"


SQL["op11_coalition_shapley"] = f"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS least FROM texts GROUP BY text),
marked AS (SELECT doc_id, part,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS m
  FROM texts JOIN firsts USING (text)),
told AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
counted AS (SELECT part, m, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad FROM marked LEFT JOIN told USING (doc_id) GROUP BY part, m),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM f a JOIN f b ON b.x <> a.x JOIN f c ON c.x NOT IN (a.x, b.x) JOIN f d ON d.x NOT IN (a.x, b.x, c.x)
  JOIN f e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
places AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS k FROM orders),
steps AS (SELECT o, k, substr(o, k, 1) AS letter, {_bit("substr(o, k, 1)")} AS own,
    {" + ".join(f"CASE WHEN k > {i} THEN {_bit(f'substr(o, {i}, 1)')} ELSE 0 END" for i in (1, 2, 3, 4))} AS earlier FROM places),
done AS (SELECT part, o AS filter_order, k AS step, letter,
    sum(CASE WHEN m & (earlier | own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN m & earlier = 0 AND m & own <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN m & earlier <> 0 AND m & own <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN m = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN m & earlier = 0 AND m & own <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN m & earlier = 0 AND m & own <> 0 THEN bad ELSE 0 END) AS toxic_lost
  FROM counted CROSS JOIN steps GROUP BY part, o, k, letter)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM done"""


@query
def op12_vocabulary_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sources of a language differ, and by which terms."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


SQL["op12_vocabulary_divergence"] = """
WITH base AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
tok AS (SELECT lang, source, doc, unnest(t) AS term FROM base),
kept AS (SELECT lang, term FROM tok GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
groups AS (SELECT DISTINCT lang, source FROM base),
c AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY lang, source, term),
every AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
summed AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, count(*) OVER (PARTITION BY lang, source) AS v,
  sum(n) OVER (PARTITION BY lang, term) AS n_lang, sum(n) OVER (PARTITION BY lang) AS total_lang FROM every),
shares AS (SELECT lang, source, term, n, 1 + 1000000000 * (n + 5)::HUGEINT // (total + 5 * v)::HUGEINT AS p,
  1 + 1000000000 * (n_lang + 5)::HUGEINT // (total_lang + 5 * v)::HUGEINT AS q FROM summed),
differ AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(d.value, 0) AS value FROM groups g JOIN groups h ON h.lang = g.lang AND h.source <> g.source
  LEFT JOIN differ d ON d.lang = g.lang AND d.source = g.source AND d.item = h.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""


@query
def op13_prefix_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 20-word windows that start earlier."""
    out = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL["op13_prefix_suffix_trees"] = """
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS win FROM texts, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS s)),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS r FROM windows),
gone AS (SELECT DISTINCT doc_id, i FROM ranked, LATERAL (SELECT unnest(range(s, s + 20)) AS i) WHERE r > 1),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM texts),
kept AS (SELECT each.doc_id, string_agg(word, ' ' ORDER BY each.i) AS t FROM each LEFT JOIN gone ON gone.doc_id = each.doc_id AND gone.i = each.i WHERE gone.i IS NULL GROUP BY each.doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT texts.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN kept ON kept.doc_id = texts.doc_id LEFT JOIN lost ON lost.doc_id = texts.doc_id"""
