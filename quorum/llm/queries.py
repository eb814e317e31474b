"""The registered queries of this subpackage, with oracle SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum.llm import ann, byte_bpe, chat_format, decontaminate, hard_negatives, kmeans, langid, mixing, near_dedup, secret_scan, token_counts, toxicity, url_filter
from quorum.llm.common import cut, table, text_crc

#: A conversation whose texts hold the template's control strings.
CONTROL_CONV, CONTROL_TEXT = -7, "\\### Assistant: </turn> ok"
#: (host, path, verdict).
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


#: The vocabularies that op3 counts by and op13 encodes by.
VOCABULARY, RANKS = "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = text_crc(F.col("doc_id")) % 3 == 1
    found = langid.with_languages(docs.select("doc_id", "text"), langid.learn(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = token_counts.read_vocabulary(public_tokenizers.path(VOCABULARY))
    return token_counts.with_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).select("doc_id", "n_tokens")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = text_crc(F.col("doc_id")) % 4 == 2
    scored = toxicity.with_scores(docs, toxicity.train_on(docs, table(spark, sf_dir, "labels"), ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.with_hits(docs, table(spark, sf_dir, "benchmark"), null_ids=True).select("doc_id", F.explode("hits").alias("hit"))
    return found.select("doc_id", "hit.*")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(CONTROL_CONV, 0, "user", CONTROL_TEXT), (CONTROL_CONV, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.format_examples(talks.unionByName(control)))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secret_scan.train_forest(secret_scan.labelled_findings(spark))
    found = secret_scan.scan(table(spark, sf_dir, "documents"), forest)
    return found.select("doc_id", "place", F.length("secret").alias("length"), F.sha2("secret", 256).alias("secret_sha256"), "score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = kmeans.ball_kmeans(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return kmeans.with_inertia(cut(assigned.drop("embedding")), centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coder = byte_bpe.Coder(byte_bpe.read_ranks(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)
    rows = byte_bpe.with_bytes(byte_bpe.with_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), coder), coder)
    return rows.select("doc_id", byte_bpe.n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_language": op1_language,
    "op2_chat_format": op2_chat_format,
    "op3_token_counts": op3_token_counts,
    "op4_nearest": op4_nearest,
    "op5_url_filter": op5_url_filter,
    "op6_near_dedup": op6_near_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_decontaminate": op8_decontaminate,
    "op9_mix": op9_mix,
    "op10_secret_scan": op10_secret_scan,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_ball_kmeans": op12_ball_kmeans,
    "op13_byte_bpe": op13_byte_bpe,
    "pipeline": corpus_pipeline.run,
}

def _kmeans_sql(rounds: int = kmeans.ROUNDS) -> str:
    """Plain k-means over all pairs of a vector and a centroid, one round after the other."""
    nearest = """
        a{r} AS MATERIALIZED (
          SELECT k, vec_id, x, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
          FROM (SELECT k, vec_id, x, cluster, CAST(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{r})
          GROUP BY k, vec_id, x)"""
    moved = """
        s{r} AS (SELECT cluster, place, sum(e) AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS e, unnest(range(64)) AS place FROM a{r}) GROUP BY cluster, place),
        m{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS c FROM s{r} GROUP BY cluster),
        c{n} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))"""
    steps = [nearest.format(r=0)]
    for r in range(rounds):
        steps += [moved.format(r=r, n=r + 1), nearest.format(r=r + 1)]
    return """
        WITH v AS MATERIALIZED (
          SELECT row_number() OVER () AS k, vec_id, [CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS x
          FROM embeddings WHERE len(embedding) = 64 AND list_bool_and([e IS NOT NULL AND isfinite(coalesce(e, 0)) FOR e IN embedding])),
        c0 AS MATERIALIZED (SELECT CAST(place - 1 AS INT) AS cluster, x AS c FROM (SELECT x, row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, x) AS place FROM v) WHERE place <= 8),
        {steps}
        SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
          sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{last} JOIN c{last} USING (cluster)""".replace("{steps}", ",".join(steps)).replace("{last}", str(rounds))


ORACLE_SQL = {
    "op2_chat_format": r"""
        WITH talks AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
          UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        told AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM talks),
        sized AS (
          SELECT *, 14 + 2 * length(role) - length(translate(role, '\#<:', '')) + 2 * length(text) - length(translate(text, '\#<', '')) AS n FROM told),
        summed AS (
          SELECT *, sum(n) OVER w AS total, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id, own) AS turns
          FROM sized WINDOW w AS (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
          CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
          CAST(sum(total) FILTER (role = 'assistant' OR place = turns) AS BIGINT) AS formatted_chars,
          count(*) FILTER (role = 'assistant' OR place = turns) AS n_examples
        FROM summed GROUP BY conv_id, own""",
    "op5_url_filter": r"""
        WITH split AS (
          SELECT page_id,
            translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
            row_number() OVER () AS k
          FROM pages),
        rules(rule_host, rule_path, rule_verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'),
          ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        met AS (
          SELECT *, row_number() OVER (PARTITION BY k ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS best
          FROM split LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(rule_verdict, 'allow') AS verdict FROM met WHERE best = 1""",
    "op6_near_dedup": r"""
        WITH RECURSIVE words AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM words),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
        both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reached(doc_id, other) AS (SELECT a, b FROM both_ways UNION SELECT doc_id, b FROM reached JOIN both_ways ON other = a),
        least_of AS (SELECT doc_id, min(other) AS least FROM reached GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id <= coalesce(least, doc_id) AS kept
        FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of USING (doc_id)""",
    "op4_nearest": r"""
        WITH v AS (
          SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS x FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and([e IS NOT NULL AND isfinite(coalesce(e, 0)) FOR e IN embedding]) AND list_bool_or([coalesce(e, 0) <> 0 FOR e IN embedding])
          GROUP BY vec_id),
        d AS (
          SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
          FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS place FROM d)
        SELECT query_id, CAST(place AS INT) AS rank, vec_id, score FROM r WHERE place <= 10""",
    "op8_decontaminate": r"""
        WITH w AS (
          SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        i AS (
          SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL),
        items AS (SELECT row_number() OVER () AS item, item_id, w, len(w) AS words, least(len(w), 5) AS g, len(w) - least(len(w), 5) + 1 AS n FROM i WHERE len(w) > 0),
        item_grams AS (SELECT item, g, gram, count(*) AS m FROM (SELECT item, g, unnest(list_transform(range(1, n + 1), lambda p: array_to_string(w[p:p + g - 1], ' '))) AS gram FROM items) GROUP BY ALL),
        doc_grams AS (
          SELECT k, g, len(w) - g + 1 AS n, unnest(range(0, len(w) - g + 1)) AS pos, unnest(list_transform(range(1, len(w) - g + 2), lambda p: array_to_string(w[p:p + g - 1], ' '))) AS gram
          FROM w, (SELECT DISTINCT g FROM items) WHERE len(w) >= g),
        met AS (SELECT k, item, d.n AS doc_n, pos, gram, m FROM doc_grams d JOIN item_grams USING (g, gram)),
        windows AS (
          SELECT DISTINCT k, item, unnest(range(greatest(0, pos - least(i.n, doc_n) + 1), least(pos, doc_n - least(i.n, doc_n)) + 1)) AS start, least(i.n, doc_n) AS n
          FROM met JOIN items i USING (item)),
        counted AS (
          SELECT k, item, start, n, m, count(*) AS c FROM windows JOIN met USING (k, item) WHERE pos >= start AND pos < start + n GROUP BY k, item, start, n, m, gram),
        both_of AS (SELECT k, item, start, n, sum(least(c, m)) AS shared FROM counted GROUP BY ALL),
        hits AS (
          SELECT k, item_id, words, start, shared / (both_of.n + items.n - shared) AS similarity FROM both_of JOIN items USING (item) WHERE 4 * shared >= 3 * (both_of.n + items.n - shared)),
        best AS (SELECT *, row_number() OVER (PARTITION BY k, item_id, words ORDER BY similarity DESC, start) AS place FROM hits)
        SELECT doc_id, item_id, similarity, CAST(start AS INT) AS start, CAST(words AS INT) AS words FROM best JOIN w USING (k) WHERE place = 1""",
    "op9_mix": r"""
        WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
        numbered AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") AS source_no FROM sources),
        weighed AS (SELECT *, CAST([5, 2, 1][(source_no - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 2e0 AS most FROM numbered),
        levels AS (
          SELECT *, (sum(source_size) OVER () * 1.5e0 - coalesce(sum(most) OVER earlier, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
          FROM weighed WINDOW earlier AS (ORDER BY most / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        targets AS (SELECT *, coalesce(least(most, max(level) FILTER (most / weight >= level) OVER () * weight), most) AS target FROM levels),
        shuffled AS (
          SELECT doc_id, size, t.*, CAST(('0x' || substr(md5(concat_ws('|', '17', CAST(doc_id AS VARCHAR), CAST(size AS VARCHAR))), 1, 15)) AS BIGINT) AS shuffled
          FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
        paced AS (
          SELECT *, row_number() OVER () AS k, CAST(sum(size) OVER (PARTITION BY source_no ORDER BY shuffled, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done FROM shuffled),
        queue AS (SELECT *, (copy * source_size + done) / weight AS finish_at FROM paced, (VALUES (0), (1)) AS c(copy)),
        running AS (SELECT *, sum(size) OVER (ORDER BY finish_at, source_no, copy, shuffled, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS words FROM queue)
        SELECT doc_id, size, source_size, target, CAST(coalesce(sum(size) FILTER (words <= budget), 0) AS BIGINT) AS taken, CAST(count(*) FILTER (words <= budget) AS INT) AS copies, done / weight AS finish
        FROM running, (SELECT floor(sum(size) * 1.5e0) AS budget FROM sized) GROUP BY k, doc_id, size, source_size, target, done, weight""",
    "op11_hard_negatives": """
        WITH v AS MATERIALIZED (
          SELECT vec_id, min({'x': [CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding], 'y': CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END}) AS r
          FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and([e IS NOT NULL AND isfinite(coalesce(e, 0)) FOR e IN embedding]), true)
          GROUP BY vec_id),
        pairs AS MATERIALIZED (
          SELECT a.vec_id AS anchor_id, b.vec_id, a.r.y = b.r.y AS alike, CAST(coalesce(list_sum(list_transform(list_zip(a.r.x, b.r.x), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.r.x) = len(b.r.x)),
        positives AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM pairs WHERE alike),
        met AS (
          SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
            row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS place
          FROM positives p JOIN pairs n USING (anchor_id) WHERE p.place <= 5 AND NOT n.alike AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
        SELECT anchor_id, positive_id, CAST(place AS INT) AS rank, negative_id, positive_score, negative_score FROM met WHERE place <= 3""",
    "op12_ball_kmeans": _kmeans_sql(),
}
