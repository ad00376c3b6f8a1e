"""The operators applied to the test tables, with production parameters."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hard_negatives, mixing, near_duplicates, periodic, phrases, placement, quality, token_files, tool_calls, top_k, vp_tree, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        find_package(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def find_package(spark: SparkSession) -> None:
    """Let Python workers import this package where they see the driver's folders; elsewhere it is
    shipped with ``--py-files``."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def word_bpe() -> str:
    """The public tokenizer that the queries use."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tools of the derived log: type of each parameter and whether it is required.
TOOLS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "convert": {"value": ("number", True), "unit": ("string", True)},
    "note": {"text": ("string", True), "pinned": ("boolean", False), "tags": ("array", False)},
}


def tool_log(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that follow from a conversation's turns.

    An assistant's turn is a call and the user's turn behind it the result. The length of the text
    decides on the tool, on what is wrong with the arguments, on what the call needs (earlier calls)
    and whether it reaches the log three turns late.
    """
    rows = conversations.withColumn("n", F.length(F.coalesce("text", F.lit(""))))

    def call_id(back: int) -> Column:
        return F.concat(F.lit("c"), F.substring(F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))), 1, 12))

    def json(*parts: tuple[str, Column]) -> Column:
        return F.to_json(F.struct(*(value.alias(name) for name, value in parts)))

    n, text = F.col("n"), F.coalesce("text", F.lit(""))
    limit = F.when(n % 11 == 0, json(("query", text), ("limit", n.cast("string")))).when(n % 7 == 0, json(("limit", n))).otherwise(json(("query", text), ("limit", n)))
    convert = F.when(n % 7 == 0, json(("value", n))).when(n % 11 == 0, json(("value", n), ("unit", text), ("digits", F.lit(2)))).otherwise(json(("value", n), ("unit", text)))
    note = F.when(n % 7 == 0, json(("tags", F.array(F.lit("a"), text)))).otherwise(json(("text", text), ("tags", F.array(F.lit("b"))), ("pinned", n % 2 == 0)))
    name = F.when(n % 17 == 0, "unheard").when(n % 3 == 0, "search").when(n % 3 == 1, "convert").otherwise("note")
    arguments = F.when(n % 3 == 0, limit).when(n % 3 == 1, convert).otherwise(note)
    calls = rows.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") + F.when(n % 5 == 0, 3).otherwise(0)).alias("turn"), call_id(0).alias("call_id"), name.alias("name"),
        F.when(n % 13 == 0, F.substring(arguments, F.lit(1), F.length(arguments) - 1)).otherwise(arguments).alias("arguments"),
        F.when(F.col("turn") < 2, F.array().cast("array<string>")).when(n % 4 == 0, F.array(call_id(2), call_id(4))).otherwise(F.array(call_id(2))).alias("needs"),
    )
    results = rows.where("role = 'user' AND turn > 0").select("conv_id", "turn", call_id(1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


@query
def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls and results of all conversations, linked, ordered, checked and serialised."""
    linked = tool_calls.link(*tool_log(table(spark, sf_dir, "conversations")), TOOLS)
    return linked.withColumn("errors", F.concat_ws("; ", "errors"))


ORACLES["op1_tool_calls"] = r"""
WITH RECURSIVE base AS (
    SELECT conv_id, turn, role, text, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
        to_json(coalesce(text, '')) AS q FROM conversations
), logged AS (
    SELECT conv_id, turn AS own, turn + CASE WHEN n % 5 = 0 THEN 3 ELSE 0 END AS turn, n,
        CASE WHEN n % 17 = 0 THEN 'unheard' ELSE ['search', 'convert', 'note'][n % 3 + 1] END AS name,
        CASE n % 3
            WHEN 0 THEN CASE WHEN n % 11 = 0 THEN '{"query":' || q || ',"limit":"' || n || '"}' WHEN n % 7 = 0 THEN '{"limit":' || n || '}' ELSE '{"query":' || q || ',"limit":' || n || '}' END
            WHEN 1 THEN CASE WHEN n % 7 = 0 THEN '{"value":' || n || '}' WHEN n % 11 = 0 THEN '{"value":' || n || ',"unit":' || q || ',"digits":2}' ELSE '{"value":' || n || ',"unit":' || q || '}' END
            ELSE CASE WHEN n % 7 = 0 THEN '{"tags":["a",' || q || ']}' ELSE '{"text":' || q || ',"tags":["b"],"pinned":' || (n % 2 = 0) || '}' END
        END AS said,
        CASE n % 3
            WHEN 0 THEN CASE WHEN n % 11 = 0 THEN '{"limit":"' || n || '","query":' || q || '}' WHEN n % 7 = 0 THEN '{"limit":' || n || '}' ELSE '{"limit":' || n || ',"query":' || q || '}' END
            WHEN 1 THEN CASE WHEN n % 7 = 0 THEN '{"value":' || n || '}' WHEN n % 11 = 0 THEN '{"digits":2,"unit":' || q || ',"value":' || n || '}' ELSE '{"unit":' || q || ',"value":' || n || '}' END
            ELSE CASE WHEN n % 7 = 0 THEN '{"tags":["a",' || q || ']}' ELSE '{"pinned":' || (n % 2 = 0) || ',"tags":["b"],"text":' || q || '}' END
        END AS canonical,
        CASE WHEN n % 13 = 0 THEN 'arguments are no object' WHEN n % 17 = 0 THEN 'tool is unknown'
            WHEN n % 3 = 0 AND n % 11 = 0 THEN 'limit is no integer' WHEN n % 3 = 0 AND n % 7 = 0 THEN 'query is missing'
            WHEN n % 3 = 1 AND n % 7 = 0 THEN 'unit is missing' WHEN n % 3 = 1 AND n % 11 = 0 THEN 'digits is unknown'
            WHEN n % 3 = 2 AND n % 7 = 0 THEN 'text is missing' END AS wrong
    FROM base WHERE role = 'assistant'
), needs AS (
    SELECT conv_id, own, own - 2 AS need FROM logged WHERE own >= 2
    UNION ALL SELECT conv_id, own, own - 4 FROM logged WHERE own >= 2 AND n % 4 = 0
), climb AS (  -- every chain of needs, from a call to one that it waits for
    SELECT conv_id, own, turn, turn AS reached, 0 AS step FROM logged
    UNION
    SELECT climb.conv_id, needs.own, logged.turn, greatest(climb.reached, logged.turn), CASE WHEN logged.turn > climb.reached THEN 0 ELSE climb.step + 1 END
    FROM climb JOIN needs ON needs.conv_id = climb.conv_id AND needs.need = climb.own
        JOIN logged ON logged.conv_id = needs.conv_id AND logged.own = needs.own
), placed AS (
    SELECT conv_id, own, max({'t': reached, 's': step}) AS p FROM climb GROUP BY conv_id, own
), missing AS (
    SELECT needs.conv_id, needs.own, string_agg('needs c' || substr(md5(needs.conv_id || ':' || need), 1, 12) || ', which is not there', '; '
        ORDER BY substr(md5(needs.conv_id || ':' || need), 1, 12)) AS absent
    FROM needs LEFT JOIN logged ON logged.conv_id = needs.conv_id AND logged.own = needs.need WHERE logged.own IS NULL GROUP BY ALL
), answers AS (
    SELECT conv_id, turn, turn - 1 AS own, text FROM base WHERE role = 'user' AND turn > 0
), calls AS (
    SELECT l.*, 'c' || substr(md5(l.conv_id || ':' || l.own), 1, 12) AS call_id, p.t AS placed_turn, p.s AS step, absent
    FROM logged l JOIN placed USING (conv_id, own) LEFT JOIN missing USING (conv_id, own)
)
SELECT conv_id, placed_turn, step, call_id, 0 AS part, turn, CASE WHEN EXISTS (SELECT 1 FROM answers a WHERE a.conv_id = calls.conv_id AND a.own = calls.own) THEN 'linked' ELSE 'no result' END AS link,
    concat_ws('; ', wrong, absent) AS errors,
    '{"arguments":' || CASE WHEN n % 13 = 0 THEN to_json(left(said, length(said) - 1)) ELSE canonical END || ',"id":"' || call_id || '","name":"' || name || '","type":"call"}' AS json
FROM calls
UNION ALL
SELECT a.conv_id, coalesce(c.placed_turn, a.turn), coalesce(c.step, 0), i.id, 1, a.turn, CASE WHEN c.call_id IS NULL THEN 'no call' ELSE 'linked' END, '',
    '{"content":' || coalesce(to_json(text), 'null') || ',"id":"' || i.id || '","type":"result"}'
FROM answers a, LATERAL (SELECT 'c' || substr(md5(a.conv_id || ':' || a.own), 1, 12) AS id) i LEFT JOIN calls c ON c.conv_id = a.conv_id AND c.own = a.own
"""


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored."""
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "quality.*")


@query
def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), word_bpe())


@query
def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector."""
    return top_k.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op4_exact_top_k"] = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    return mixing.mix(table(spark, sf_dir, "documents"), keep_row=False).drop("draws")


ORACLES["op5_source_mixing"] = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        ('0x' || substr(md5(doc_id::VARCHAR || ':' || coalesce(text, '')), 1, 15))::BIGINT AS spot
    FROM documents
), named AS (
    SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) AS i FROM sized GROUP BY source
), weighed AS (
    SELECT *, ([3, 1, 2])[(i - 1) % 3 + 1] AS w, sum(n) OVER () * 1.5::DOUBLE AS total FROM named
), filled AS (  -- by the room for each unit of weight; a source is full if the level so far lifts it above
    SELECT *, total - coalesce(sum(2 * n) OVER least_room, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER least_room, 0) AS open_weight
    FROM weighed WINDOW least_room AS (ORDER BY n / w::DOUBLE, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), full_ones AS (
    SELECT *, rest * w > 2 * n * open_weight AS is_full FROM filled
), shared AS (
    SELECT source, n, CASE WHEN is_full THEN 2.0 * n ELSE (total - coalesce(sum(2 * n) FILTER (is_full) OVER (), 0)) * w / (sum(w) FILTER (NOT is_full) OVER ()) END::DOUBLE AS target
    FROM full_ones
), given AS (
    SELECT *, CASE WHEN n > 0 THEN floor(target + 1e-6)::BIGINT // n ELSE 0 END AS passes, CASE WHEN n > 0 THEN floor(target + 1e-6)::BIGINT % n ELSE 0 END AS rest FROM shared
), placed AS (
    SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY spot, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sized
)
SELECT doc_id, size, n AS source_size, target, (passes * size + CASE WHEN 2 * (rest - start) >= size THEN size ELSE 0 END)::BIGINT AS taken
FROM placed JOIN given ON placed.source IS NOT DISTINCT FROM given.source
"""


@query
def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    files = warc.write(table(spark, sf_dir, "pages"), revisit_bytes=0)

    def page(name: str) -> Column:
        return F.regexp_extract(F.coalesce(name, F.lit("")), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")

    records = warc.read(files, with_payload=False)
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


ORACLES["op6_warc_round_trip"] = """
WITH hashed AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), known AS (
    SELECT *, max(page_id) OVER (PARTITION BY h) AS owner,
        array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT, 1)), '') AS payload_digest
    FROM hashed
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NULL AND owner IS NOT NULL OR page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS NULL OR page_id <> owner THEN owner END AS refers_to
FROM known
"""


@query
def op7_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest of every twentieth vector, as far as found."""
    return vp_tree.near_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to files of ids and looked up in them again."""
    docs = table(spark, sf_dir, "documents")
    manifest = token_files.write(docs, word_bpe(), end_id=2)
    return token_files.read(spark, manifest, docs).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "occurrence"
    )


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of near-duplicates."""
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), words=3, similarity=85)


SHARDS = [f"shard-{i:03d}" for i in range(64)]


@query
def op10_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return placement.place(table(spark, sf_dir, "documents"), SHARDS).select("doc_id", "slot", "shard")


ORACLES["op10_shard_placement"] = f"""
WITH slots AS (
    SELECT i AS slot, 'shard-' || lpad(([{",".join(map(str, placement.lookup_table(SHARDS)))}])[i + 1]::VARCHAR, 3, '0') AS shard FROM range({placement.TABLE_SIZE}) AS r(i)
), keyed AS (
    SELECT doc_id, (('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % {placement.TABLE_SIZE})::INTEGER AS slot FROM documents
)
SELECT doc_id, keyed.slot, shard FROM keyed JOIN slots ON keyed.slot = slots.slot
"""


WORD = r"([^\x20\x09-\x0D]+)"


def with_repeats(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth or so, by the checksum of its id, has its end written anew: the
    words from some place on repeat a stretch over and over."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(1))
    sums = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", sums.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    rows = rows.withColumn("a", F.when(n > 0, g % n)).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("long"))
    again = F.transform(F.sequence(F.col("a").cast("long"), (n - 1).cast("long")), lambda i: F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    text = F.concat_ws(" ", F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), again))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, and what is left of it without their repetitions."""
    found = periodic.periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    best = periodic.longest(F.col("runs"))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(periodic.listing(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op11_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier document has."""
    left = phrases.remove_repeated(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op11_repeated_phrases"] = r"""
WITH split AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), placed AS (
    SELECT r, doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM split
), windows AS (
    SELECT r, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS said FROM placed
), firsts AS (
    SELECT said, min(doc_id) AS first FROM windows GROUP BY said
), covered AS (
    SELECT DISTINCT r, i + j AS place FROM windows JOIN firsts USING (said), range(13) AS w(j) WHERE first < doc_id
), words AS (
    SELECT r, unnest(range(1, len(ws) + 1)) AS place, unnest(ws) AS word FROM split
), kept AS (
    SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS left_over FROM words ANTI JOIN covered USING (r, place) GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (r)
"""


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; some labels are moved on by one first."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLES["op12_hard_negatives"] = """
WITH whole AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
    FROM whole a JOIN whole c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
