"""The queries op1 to op13 over the synthetic tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import chat, chroma, hard_negatives, html_text, pieces, quality, toxicity, url_filter, vector_codes
from loomwork.llm.common import stored, table
from loomwork.llm.exact_topk import top_k
from loomwork.llm.mixing import mix
from loomwork.llm.near_dedup import near_duplicates
from loomwork.llm.substring_dedup import remove_repeats


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), query_divisor=100, k=10)


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), url_filter.build(spark, URL_RULES))


def op3_media_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has audio, so two takes are rendered of each embedding (ids 2 * vec_id and 2 * vec_id + 1).

    Every recording counts for the levels and is indexed; the first takes of vec_ids divisible by 50 are the queries. A row is a query with all its
    links to classes of recordings, and their number."""
    vectors = table(spark, sf_dir, "embeddings")
    levels = chroma.fit_levels(chroma.rendered(vectors))
    marks = stored(chroma.fingerprints(chroma.rendered(vectors), levels), "fingerprints")
    return chroma.by_query(stored(chroma.align(marks, query_divisor=100), "links"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.train(spark, docs, table(spark, sf_dir, "labels")))


PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = PIECE_MODEL) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), model_path)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.judged(docs, toxicity.train(spark, docs, table(spark, sf_dir, "labels")))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=5, percent=85)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), window=20)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


#: A conversation whose text looks like the template's own marks.
TRICKY = (-7, "\\### Assistant: </turn> ok")


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that looks like the template, formatted and read back from the blocks that were written."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(TRICKY[0], i, role, TRICKY[1]) for i, role in enumerate(("user", "assistant"))], turns.schema)
    return chat.read_back(chat.formatted(turns.unionByName(tricky)))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of vec_ids divisible by 7 are moved on by one first, so that near rows of other labels exist."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(rows.withColumn("label", moved))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk": op1_exact_topk,
    "op2_url_filters": op2_url_filters,
    "op3_media_chroma": op3_media_chroma,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_html_extraction": op6_html_extraction,
    "op7_toxicity": op7_toxicity,
    "op8_source_mixing": op8_source_mixing,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_chat_formatting": op12_chat_formatting,
    "op13_hard_negatives": op13_hard_negatives,
}


def _code_rounds(rounds: int = 4) -> str:
    """Assignments a0, a1, ... and codebooks c1, c2, ... of each round, from parts p and the codebook c0."""
    out = []
    for i in range(rounds + 1):
        out.append(
            f"a{i} AS MATERIALIZED (SELECT rid, part, min_by(entry, [d, entry]) AS entry, min(d) AS d FROM (SELECT rid, p.part, entry, list_dot_product(x, x) + list_dot_product(c, c) - 2 * list_dot_product(x, c) AS d FROM p JOIN c{i} USING (part)) GROUP BY rid, part)"
        )
        if i < rounds:
            out.append(
                f"s{i} AS (SELECT part, entry, list(m ORDER BY j) AS c FROM (SELECT part, entry, j, floor(sum(x) / count(*)) AS m FROM (SELECT p.part, entry, unnest(x) AS x, unnest(range(len(x))) AS j FROM p JOIN a{i} USING (rid, part)) GROUP BY part, entry, j) GROUP BY part, entry),\n"
                f"c{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(s{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN s{i} USING (part, entry))"
            )
    return ",\n".join(out)


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

ORACLES: dict[str, str] = {
    "op1_exact_topk": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op2_url_filters": r"""
WITH r AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM r),
u(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT h.page_id, u.rh || u.rp AS rule, v, row_number() OVER (PARTITION BY h.page_id ORDER BY length(rh) + length(rp) DESC, length(rh) DESC) AS k
  FROM h JOIN u ON (h.host = rh OR ends_with(h.host, '.' || rh)) AND starts_with(h.path, rp))
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM h LEFT JOIN m ON m.page_id = h.page_id AND m.k = 1
""",
    "op8_source_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM d GROUP BY source),
k AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, CAST(sum(source_size) OVER () AS DOUBLE) AS total, 2.0::DOUBLE * source_size AS most FROM p),
w AS (SELECT *, CAST([5, 2, 1][(rank - 1) % 3 + 1] AS DOUBLE) AS w FROM k),
l AS (
  SELECT *, (1.5::DOUBLE * total - coalesce(sum(most) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY most / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min_by(level, [most / w, rank]) AS level FROM l WHERE most / w > level),
t AS (SELECT l.*, least(most, w * (SELECT level FROM f)) AS target, CAST(round(1.5::DOUBLE * total / 4) AS BIGINT) AS seats FROM l),
-- every seat of every source, ranked by quotient
q AS (
  SELECT rank, target / (2 * i - 1) AS quotient, i FROM (
    SELECT rank, target, unnest(range(1, CAST(target / 4 AS BIGINT) + (SELECT count(*) + 2 FROM t))) AS i FROM t)),
a AS (SELECT rank, count(*) AS blocks FROM (SELECT rank, row_number() OVER (ORDER BY quotient DESC, rank, i) AS n FROM q) WHERE n <= (SELECT max(seats) FROM t) GROUP BY rank),
s AS (SELECT t.source, t.rank, t.source_size, t.target, CAST(ceil(t.n_docs / 2000) AS BIGINT) AS shards, coalesce(a.blocks, 0) AS blocks FROM t LEFT JOIN a USING (rank)),
h AS (SELECT d.doc_id, d.size, s.*, md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')) AS h FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
g AS (SELECT *, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % shards AS shard FROM h),
z AS (SELECT rank, shard, CAST(sum(size) AS BIGINT) AS shard_size, max(blocks) AS blocks FROM g GROUP BY rank, shard),
y AS (
  SELECT rank, shard, i, row_number() OVER (PARTITION BY rank ORDER BY shard_size / (2 * i - 1) DESC, shard, i) AS n, blocks FROM (
    SELECT rank, shard, shard_size, blocks, unnest(range(1, CAST(blocks AS BIGINT) + 2)) AS i FROM z)),
x AS (SELECT rank, shard, count(*) * 4 AS quota FROM y WHERE n <= blocks GROUP BY rank, shard),
b AS (
  SELECT g.*, z.shard_size, coalesce(x.quota, 0) AS quota,
    CAST(coalesce(sum(g.size) OVER (PARTITION BY g.rank, g.shard ORDER BY g.h, g.doc_id, g.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin
  FROM g JOIN z USING (rank, shard) LEFT JOIN x USING (rank, shard))
SELECT doc_id, size, source_size, target,
  CAST(greatest(least(begin + size, quota) - begin, 0) + greatest(least(begin + size, quota - shard_size) - begin, 0) AS BIGINT) AS taken
FROM b
""",
    "op9_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
t AS (SELECT doc_id, unnest(ws) AS t, unnest(range(len(ws))) AS i, len(ws) AS n FROM w),
g AS (
  SELECT doc_id, i, n, t || ' ' || lead(t, 1) OVER o || ' ' || lead(t, 2) OVER o || ' ' || lead(t, 3) OVER o || ' ' || lead(t, 4) OVER o AS g
  FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
e AS (
  SELECT DISTINCT doc_id, g FROM g WHERE i <= n - 5
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT w.doc_id, count(e.g) AS n FROM w LEFT JOIN e USING (doc_id) GROUP BY w.doc_id),
f AS (SELECT g, count(*) AS df FROM e GROUP BY g),
p AS (  -- any linked pair shares one of the rarest floor(0.15 n) + 1 shingles of either side
  SELECT doc_id, g FROM (
    SELECT e.doc_id, e.g, n.n, row_number() OVER (PARTITION BY e.doc_id ORDER BY f.df, e.g) AS r
    FROM e JOIN f USING (g) JOIN n USING (doc_id))
  WHERE r <= n - CAST(ceil(0.85 * n) AS BIGINT) + 1),
c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y ON x.g = y.g AND x.doc_id < y.doc_id),
i AS (SELECT c.a, c.b, count(*) AS k FROM c JOIN e x ON x.doc_id = c.a JOIN e y ON y.doc_id = c.b AND y.g = x.g GROUP BY c.a, c.b),
l AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * i.k >= 85 * (x.n + y.n - i.k)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS to_id FROM documents UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.to_id),
m AS (SELECT id, min(to_id) AS component_id FROM r GROUP BY id)
SELECT n.doc_id, n.n AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN m ON m.id = n.doc_id
""",
    "op10_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS s, ws FROM w WHERE len(ws) >= 20),
q AS (SELECT doc_id, s, sha256(array_to_string(ws[s : s + 19], ' ')) AS h FROM p),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM q),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM r WHERE k > 1),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (
  SELECT w.doc_id, len(w.ws) AS n, coalesce(len(g.gone), 0) AS n_gone,
    CASE WHEN g.gone IS NULL THEN w.ws ELSE list_transform(list_sort(list_filter(range(1, len(w.ws) + 1), lambda i: NOT list_contains(g.gone, i))), lambda i: w.ws[i]) END AS kept
  FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n_gone AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
""",
    "op11_vector_codes": f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {_FINITE}),
p AS MATERIALIZED (SELECT rid, part, v[CAST(part * len(v) / 4 AS BIGINT) + 1 : CAST((part + 1) * len(v) / 4 AS BIGINT)] AS x FROM k, range(4) t(part)),
c0 AS (SELECT part, rid - 1 AS entry, x AS c FROM p WHERE rid <= 256),
{_code_rounds()},
f AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS h FROM c4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM h) AS codebooks_sha256 FROM k JOIN f USING (rid)
""",
    "op12_chat_formatting": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM (VALUES (0), (1)) v(i)),
m AS (
  SELECT *, length(role) + len(regexp_extract_all(role, '[\\#:]')) + len(regexp_extract_all(role, '</')) + length(text) + len(regexp_extract_all(text, '[\\#]')) + len(regexp_extract_all(text, '</')) + 15 AS n FROM t),
r AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS through, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR last THEN through ELSE 0 END) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
""",
    "op13_hard_negatives": f"""
WITH r AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
s AS MATERIALIZED (
  SELECT a.rid AS a, a.vec_id AS anchor_id, c.rid AS c, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score FROM r a JOIN r c ON a.rid <> c.rid WHERE a.vec_id % 100 = 0),
p AS (
  SELECT a, anchor_id, c AS p, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 100 * s.score BETWEEN 30 * positive_score AND 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""",
}
