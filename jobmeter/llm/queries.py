"""The registered query of each operator, and its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmeter.llm import (
    boilerplate, chat, language, lexical, lines, mixing, near_copies, packing, periodic, perplexity, posting_lists,
    url_lists, vector_copies,
)
from jobmeter.llm.tables import WORD, documents


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a quarter of the documents is held out of training."""
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.train(docs.where(~held_out).select("text", "lang"))
    keyed = docs.select("doc_id", held_out.alias("held_out"), "text")
    return language.identify(keyed, model, keep=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def url_list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries over the hosts of the pages: hosts, their registered domains and path beginnings.

    Which hosts are listed, and when, follows from their digests.
    """
    host, path = url_lists.host_and_path(F.col("url"))
    seen = pages.select(host.alias("host"), F.get(path, 0).alias("step")).where("host <> ''").distinct()
    number = F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("int")
    keyed = seen.withColumn("x", number)
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("x") % 200)
    domain = F.substring_index("host", ".", -2)

    def entry(rule: Column, name: str, key: Column, action: str, days: int) -> Column:
        listed = F.date_add(day, days).alias("listed_at")
        return F.when(
            rule, F.struct(F.lit(name).alias("list"), key.alias("key"), F.lit(action).alias("action"), listed)
        )

    x, host, place = F.col("x"), F.col("host"), F.concat_ws("/", "host", "step")
    rows = F.array(
        entry(x % 3 < 2, "hosts", host, "block", 0),
        entry(x % 2 == 0, "hosts", host, "remove", 70),
        entry(x % 5 < 2, "appeals", host, "allow", 30),
        entry(x % 7 < 3, "paths", place, "allow", 20),
        entry(x % 7 < 2, "paths", place, "block", 50),
        entry(x % 11 < 2, "domains", domain, "block", 100),
    )
    return keyed.select(F.inline(F.filter(rows, lambda r: r.isNotNull()))).distinct()


def op2_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the lists of its fetch day; the day follows from page_id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int"))
    judged = url_lists.judge(pages.withColumn("fetched_at", day), url_list_entries(pages))
    text = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return judged.select("page_id", "url", text("fetched_at"), "decision", "rule", "rule_list", text("rule_from"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = mixing.mix(documents(spark, sf_dir), keep=["doc_id", "source"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the perspective of each of its speakers."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    span = lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))
    return chat.perspectives(turns).withColumn("mask", F.array_join(F.transform("mask", span), ","))


def op5_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every 20th vector."""
    return posting_lists.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.digests(packing.pack(documents(spark, sf_dir)))


def op7_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of every document."""
    return perplexity.judge(documents(spark, sf_dir), keep=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "perplexity", "deviation",
    )


def op8_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document among near copies."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return near_copies.near_copies(docs).select("doc_id", "n_shingles", "component_id", "kept")


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document without repeated lines."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return lines.drop_repeated_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def op10_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return boilerplate.extract(pages).select("page_id", "url", "text", "n_chars", "n_repeated")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by the checksum of their id, repeat a stretch of words to their end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    keyed = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    keyed = keyed.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), 0)))
    n = F.size("w").cast("long")
    sized = keyed.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    sized = sized.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    start, period, rest = (x.cast("int") for x in (F.col("a"), F.col("p"), F.col("n") - F.col("a")))
    again = F.array_repeat(F.slice("w", start + 1, period), F.ceil(rest / period).cast("int"))
    planted = F.concat(F.slice("w", F.lit(1), start), F.slice(F.flatten(again), F.lit(1), rest))
    return sized.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, with the runs that its id asks for planted."""
    found = periodic.find_runs(with_planted_runs(documents(spark, sf_dir)), keep=["doc_id"])
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    found = found.withColumn("best", best)
    length, period = F.col("best")["l"], -F.col("best")["p"]
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best")["s"]).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_vector_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every vector among near copies of its label."""
    return vector_copies.near_copies(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), keep=["vec_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of this subpackage by name."""
    found = (
        op1_language, op2_url_lists, op3_mixing, op4_chat, op5_posting_lists, op6_packing, op7_perplexity,
        op8_near_copies, op9_lines, op10_boilerplate, op11_lexical, op12_periodic, op13_vector_copies,
    )
    return {f.__name__: f for f in found}


LINES_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), split AS (
  SELECT r, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM docs
), keyed AS (
  SELECT r, doc_id, i, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM split
), often AS (
  SELECT k, max(doc_id) AS owner FROM (SELECT DISTINCT k, r, doc_id FROM keyed WHERE length(k) >= 40)
  GROUP BY k HAVING count(*) >= 5
), decided AS (
  SELECT r, d.doc_id, i, line, (o.k IS NOT NULL AND o.owner IS DISTINCT FROM d.doc_id) AS gone
  FROM keyed d LEFT JOIN often o ON d.k = o.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM decided GROUP BY r, doc_id
"""


NEAR_COPIES_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                 END AS s
  FROM docs
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM items x JOIN items y ON x.item = y.item AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION
  SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
), least AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sets s JOIN least l ON s.doc_id = l.doc_id
"""


URL_LISTS_SQL = r"""
WITH parsed AS (
  SELECT page_id, url,
         regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.+$', '') AS host,
         list_filter(string_split(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?[^/?#:]+(?::[0-9]*)?([^?#]*)', 1), '/'), lambda s: s <> '') AS path,
         DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS day
  FROM pages
), seen AS (
  SELECT DISTINCT host, path[1] AS step, CAST('0x' || substr(md5(host), 1, 6) AS INTEGER) AS x FROM parsed WHERE host <> ''
), dated AS (
  SELECT *, DATE '2024-01-01' + x % 200 AS d, regexp_extract(host, '([^.]*\.)?[^.]*$') AS domain,
         host || coalesce('/' || step, '') AS place
  FROM seen
), entries AS (
  SELECT 'hosts' AS list, host AS key, 2 AS strength, d AS valid_from FROM dated WHERE x % 3 < 2
  UNION SELECT 'hosts', host, 0, d + 70 FROM dated WHERE x % 2 = 0
  UNION SELECT 'appeals', host, 1, d + 30 FROM dated WHERE x % 5 < 2
  UNION SELECT 'paths', place, 1, d + 20 FROM dated WHERE x % 7 < 3
  UNION SELECT 'paths', place, 2, d + 50 FROM dated WHERE x % 7 < 2
  UNION SELECT 'domains', domain, 2, d + 100 FROM dated WHERE x % 11 < 2
), strongest AS (
  SELECT list, key, valid_from, max(strength) AS strength FROM entries GROUP BY list, key, valid_from
), valid AS (
  SELECT *, lead(valid_from) OVER (PARTITION BY list, key ORDER BY valid_from) AS valid_to FROM strongest
), covered AS (
  SELECT p.page_id, p.url, v.*,
         row_number() OVER (PARTITION BY p.page_id, p.url ORDER BY len(string_split(v.key, '/')) DESC,
                            len(string_split(string_split(v.key, '/')[1], '.')) DESC, v.strength DESC,
                            v.valid_from DESC, v.list) AS place
  FROM parsed p JOIN valid v
    ON v.strength > 0 AND v.valid_from <= p.day AND (v.valid_to IS NULL OR p.day < v.valid_to)
   AND (v.key = p.host OR ends_with(p.host, '.' || v.key)
        OR starts_with(p.host || '/' || array_to_string(p.path, '/') || '/', v.key || '/') AND contains(v.key, '/'))
)
SELECT p.page_id, p.url, strftime(p.day, '%Y-%m-%d') AS fetched_at,
       CASE WHEN p.host = '' OR p.host IS NULL THEN 'invalid' WHEN c.key IS NULL THEN 'none'
            WHEN c.strength = 2 THEN 'block' ELSE 'allow' END AS decision,
       c.key AS rule, c.list AS rule_list, strftime(c.valid_from, '%Y-%m-%d') AS rule_from
FROM parsed p LEFT JOIN covered c ON c.page_id = p.page_id AND c.url = p.url AND c.place = 1
"""

CHAT_SQL = r"""
WITH placed AS (
  SELECT conv_id, role, replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' AS body,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, substr(text, 1, 32), text) - 1 AS place
  FROM conversations
), people AS (
  SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role <> 'system'
), rendered AS (
  SELECT p.conv_id, q.perspective, p.place // 64 AS segment, p.place, p.body, p.role = q.perspective AS mine,
         '<|im_start|>' || CASE WHEN p.role IS NULL THEN 'user' WHEN p.role = 'system' THEN 'system'
           WHEN p.role = q.perspective THEN 'assistant'
           ELSE 'user name=' || regexp_replace(replace(p.role, '<|', '< |'), '\s+', '_', 'g') END || chr(10) AS head
  FROM placed p JOIN people q ON p.conv_id = q.conv_id
), offsets AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, segment ORDER BY place
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start
  FROM rendered
)
SELECT conv_id, perspective, segment::BIGINT AS segment, count(*) AS n_turns,
       string_agg(head || body || chr(10), '' ORDER BY place) AS text,
       coalesce(string_agg(start::BIGINT || '-' || (start + length(body))::BIGINT, ',' ORDER BY place) FILTER (WHERE mine), '') AS mask
FROM offsets GROUP BY conv_id, perspective, segment
"""


LEXICAL_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), worded AS (
  SELECT r, doc_id, len(w) AS n, w FROM docs WHERE len(w) > 0
), counts AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS term FROM worded)
  GROUP BY r, doc_id, n, term
), every AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS total FROM worded
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
  FROM counts, every GROUP BY term, n_docs
), items AS (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM (SELECT DISTINCT item_id, text FROM benchmark)
), asked AS (
  SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(w) AS term FROM items)
  GROUP BY item, item_id, term
), scored AS (
  SELECT a.item, a.item_id, c.r, c.doc_id,
         sum(a.times * v.weight * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (100 - 75 + (75 * c.n * e.n_docs) // e.total))))::BIGINT AS score
  FROM asked a JOIN counts c ON a.term = c.term JOIN weights v ON a.term = v.term, every e
  GROUP BY a.item, a.item_id, c.r, c.doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE score > 0
)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked WHERE place <= 10
"""


PERIODIC_SQL = r"""
WITH crc_table AS (
  SELECT list(entry ORDER BY i) AS entries FROM (
    SELECT i, list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, i) AS entry
    FROM range(256) t(i))
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(string_split(doc_id::VARCHAR, ''), lambda x, c: xor(x >> 8, entries[1 + xor(x & 255, ascii(c))]), 4294967295::BIGINT),
             4294967295) AS h
  FROM documents, crc_table
), places AS (
  SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM docs
), planted AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE
           list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END])
         END AS w
  FROM places
), words AS (
  SELECT r, n, unnest(w) AS word, unnest(range(n)) AS i FROM planted
), numbered AS (
  SELECT r, n, i, dense_rank() OVER (PARTITION BY r ORDER BY word) AS code FROM words
), pairs AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM numbered x JOIN numbered y
    ON x.r = y.r AND x.code = y.code AND x.i < y.i AND 4 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs)
  GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length
), best AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY length DESC, start, period) AS place FROM runs
), listed AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listing
  FROM runs GROUP BY r
), gone AS (
  SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT w.r, string_agg(w.word, ' ' ORDER BY w.i) AS body FROM words w ANTI JOIN gone g ON w.r = g.r AND w.i = g.i GROUP BY w.r
)
SELECT p.doc_id, coalesce(l.n_runs, 0) AS n_runs, b.start, b.length, b.period,
       (1000 * b.length) // b.period AS exponent_milli,
       sha256(coalesce(l.listing, '')) AS runs_sha256, sha256(coalesce(k.body, '')) AS collapsed_sha256
FROM planted p LEFT JOIN listed l ON p.r = l.r LEFT JOIN best b ON p.r = b.r AND b.place = 1 LEFT JOIN kept k ON p.r = k.r
"""


VECTOR_COPIES_SQL = r"""
WITH RECURSIVE vectors AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
), valid AS (
  SELECT * FROM vectors
  WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.r AS a, y.r AS b FROM valid x JOIN valid y ON x.label = y.label AND x.r <> y.r AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.98
), reach AS (
  SELECT r AS a, r AS b FROM vectors
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a AS r, min(v.vec_id) AS component_id FROM reach JOIN vectors v ON v.r = reach.b GROUP BY a
), counted AS (
  SELECT a AS r, count(*) AS n_links FROM links GROUP BY a
)
SELECT v.vec_id, coalesce(c.n_links, 0) AS n_links, l.component_id,
       l.component_id IS NOT DISTINCT FROM v.vec_id AS kept
FROM vectors v JOIN least l ON v.r = l.r LEFT JOIN counted c ON v.r = c.r
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB twins by query name."""
    return {
        "op2_url_lists": URL_LISTS_SQL,
        "op4_chat": CHAT_SQL,
        "op8_near_copies": NEAR_COPIES_SQL,
        "op9_lines": LINES_SQL,
        "op11_lexical": LEXICAL_SQL,
        "op12_periodic": PERIODIC_SQL,
        "op13_vector_copies": VECTOR_COPIES_SQL,
    }
