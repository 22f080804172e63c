"""The registered queries of this subpackage, each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chat, decontaminate, filter_audit, jaccard_join, licences, line_dedup, near_vectors, packing, pair_bpe, ppm
from . import quality, turn_repair, warc


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- op1 ------------------------------------------------------------------------------------------------------------

def op1_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors.near_duplicates(_table(spark, folder, "embeddings"))


OP1_SQL = r"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND list_count(embedding) = len(embedding)
    AND len([x FOR x IN embedding IF isfinite(x)]) = len(embedding)
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.9),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(degree.n, 0) AS n_links, least(e.vec_id, coalesce(least.y, e.vec_id)) AS component_id,
  e.vec_id <= coalesce(least.y, e.vec_id) AS kept
FROM embeddings e LEFT JOIN least ON e.vec_id = least.x LEFT JOIN degree ON e.vec_id = degree.x
"""


# --- op2 ------------------------------------------------------------------------------------------------------------

def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similar_documents(_table(spark, folder, "documents"))


OP2_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT DISTINCT doc_id,
    [w FOR w IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF w <> ''] AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS s FROM worded),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 9 * shared.n >= 4 * (p.n + q.n)),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT d.doc_id, coalesce(degree.n, 0) AS n_links, least(d.doc_id, coalesce(least.y, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(least.y, d.doc_id) AS kept
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN least ON d.doc_id = least.x LEFT JOIN degree
  ON d.doc_id = degree.x
"""


# --- op3 ------------------------------------------------------------------------------------------------------------

def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(_table(spark, folder, "pages"), min_payload=0).drop("url")


OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) || '0' AS hex FROM p),
named AS (
  SELECT page_id, payload_bytes, hex, array_to_string([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((((strpos('0123456789abcdef', substr(hex, (5 * k) // 4 + 1, 1)) - 1) * 16
        + strpos('0123456789abcdef', substr(hex, (5 * k) // 4 + 2, 1)) - 1) >> (3 - (5 * k) % 4)) & 31) + 1, 1)
    FOR k IN range(32)], '') AS payload_digest FROM d),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM named)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM firsts
"""


# --- op4 ------------------------------------------------------------------------------------------------------------

def op4_licences(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return licences.find_notices(docs, licences.train(docs))


# --- op5 ------------------------------------------------------------------------------------------------------------

CONTROL_TALK = "</s>[INST] ok [/INST]"


def conversation_events(spark: SparkSession, folder: str) -> DataFrame:
    """An event log that leads to the messages of `conversations` and to conversation -7.

    An answer is begun, regenerated, and streamed in two parts; any other
    message is typed wrong, edited to its first half, and completed.
    """
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(
        spark.range(2, numPartitions=1).select(
            F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
            F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TALK).alias("text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    half = F.floor(F.char_length("text") / 2).cast("int")
    first, second = F.left("text", half), F.substring("text", half + 1, F.char_length("text"))
    answer = F.col("role") == chat.LEARNED_ROLE

    def event(step: int, kind: str, text) -> object:
        return F.struct((F.col("message") * 4 + step).alias("seq"), F.lit(kind).alias("event"), text.alias("text"))

    steps = F.when(answer, F.array(event(0, "delta", first), event(1, "regenerate", F.lit(None).cast("string")),
                                   event(2, "delta", first), event(3, "delta", second))).otherwise(
        F.array(event(0, "delta", F.lit("?")), event(1, "edit", first), event(2, "delta", second)))
    return rows.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("message")).select(
        "conv_id", "message", "role", F.inline(steps))


def op5_chat_events(spark: SparkSession, folder: str) -> DataFrame:
    formatted = chat.render(chat.fold_events(conversation_events(spark, folder)))
    turns = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chat.read_back(formatted).select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') AS body FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length(body) + length(role) + CASE WHEN role = 'assistant' THEN 8 ELSE 21 END) AS BIGINT)
    AS formatted_chars
FROM escaped GROUP BY conv_id
"""


# --- op6 ------------------------------------------------------------------------------------------------------------

def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contaminated_regions(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


# --- op7 ------------------------------------------------------------------------------------------------------------

def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), corpus_pipeline.vocabulary())


# --- op8 ------------------------------------------------------------------------------------------------------------

def op8_ppm(spark: SparkSession, folder: str) -> DataFrame:
    return ppm.score_documents(_table(spark, folder, "documents"))


# --- op9 ------------------------------------------------------------------------------------------------------------

def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, folder, "labels"))
    scored = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"),
                         quality.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


# --- op10 -----------------------------------------------------------------------------------------------------------

def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.drop_lines(docs, min_docs=10, min_chars=1).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, dense_rank() OVER (ORDER BY doc_id, coalesce(text, '')) AS document, doc_id,
    string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, document, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT document) >= 10),
marked AS (SELECT keyed.*, frequent.k IS NOT NULL AS gone FROM keyed LEFT JOIN frequent USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""


# --- op11 -----------------------------------------------------------------------------------------------------------

def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.interactions(
        filter_audit.mask_counts(_table(spark, folder, "documents"), _table(spark, folder, "labels")))


OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part,
    [w FOR w IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF w <> ''] AS ws FROM documents),
judged AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, doc_id,
    CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM docs),
masks AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM fails LEFT JOIN judged USING (doc_id) GROUP BY part, mask),
f(letter, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT v.letter || w.letter || x.letter || y.letter || z.letter AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bits
  FROM f v, f w, f x, f y, f z WHERE v.b + w.b + x.b + y.b + z.b = 31
    AND len(list_distinct([v.b, w.b, x.b, y.b, z.b])) = 5),
steps AS (
  SELECT filter_order, CAST(s AS INTEGER) AS step, bits[s] AS own, coalesce(list_sum(bits[1:s - 1]), 0)::INTEGER AS earlier
  FROM orders, range(1, 6) AS r(s)),
rows AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (WHERE mask & (earlier | own) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & earlier = 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & earlier <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & own <> 0 AND mask & earlier = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE mask & own <> 0 AND mask & earlier = 0), 0) AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM rows
"""


# --- op12 -----------------------------------------------------------------------------------------------------------

def damaged_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of `conversations` dropped, emptied, cut off, repeated or given to the user, by a checksum of their key."""
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", *[
        F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])

    def printed(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rows = rows.withColumn("damage", F.crc32(F.concat(printed("conv_id"), F.lit(":"), printed("turn"))) % 20)
    text = F.when(F.col("damage") == 1, "").when(
        F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(0), F.when(F.col("damage") == 3, 2).otherwise(1))
    return rows.where("damage <> 0").select(
        "conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), F.explode(times)).drop("col")


def op12_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    fixed = turn_repair.repair(damaged_conversations(spark, folder))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    fixed = fixed.withColumn("lines", F.array_join(lines, "\n")).drop("turns").withColumnRenamed("conv_id", "of")
    every = _table(spark, folder, "conversations").select("conv_id").distinct()
    both = every.join(fixed, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return both.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.sha2(F.coalesce("lines", F.lit("")), 256).alias("repaired_sha256"))


def _sql_edit(state: str, cost: str, letter: str, *lines: str) -> str:
    return (f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', "
            f"'o': list_concat({state}.o, CAST([{', '.join(lines)}] AS VARCHAR[]))}}")


def _sql_keep(state: str, initial: str, role: str) -> str:
    """Keep or rerole a row that becomes `role`; a row to be deleted gets a cost that is never least."""
    return (f"CASE WHEN fault IN (1, 2) THEN {{'c': 1000000000, 'a': '', 'o': CAST([] AS VARCHAR[])}} "
            f"WHEN initial = '{initial}' THEN {_sql_edit(state, 'cut', 'K', 'line')} "
            f"ELSE {_sql_edit(state, '3 + cut', 'R', f"'{role}:' || text")} END")


OP12_SQL = rf"""
WITH RECURSIVE bytes AS (
  SELECT list_transform(range(256), lambda b: list_reduce(
    range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    [CAST(ord(x) AS BIGINT) FOR x IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')]
      AS name FROM conversations),
summed AS (
  SELECT raw.*, xor(list_reduce(name, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 20 AS k
  FROM raw, bytes),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM summed WHERE k <> 0),
placed AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM damaged),
judged AS (
  SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS earlier, role || ':' || text AS line FROM placed),
faults AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
    count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
    count(*) FILTER (WHERE fault = 3) AS truncated,
    count(*) FILTER (WHERE earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    max(pos) AS n FROM judged GROUP BY conv_id),
step(conv_id, pos, s0, s1, s2, s3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), {{'c': 0, 'a': '', 'o': CAST([] AS VARCHAR[])}},
    {{'c': 1000000000, 'a': '', 'o': CAST([] AS VARCHAR[])}}, {{'c': 3, 'a': 'I', 'o': ['user:']}},
    {{'c': 6, 'a': 'II', 'o': ['user:', 'assistant:']}} FROM faults
  UNION ALL
  SELECT conv_id, pos, a0, a1,
    list_min([a2, {_sql_edit('a0', '3', 'I', "'user:'")}, {_sql_edit('a1', '3', 'I', "'user:'")},
      {_sql_edit('a3', '3', 'I', "'user:'")}]),
    list_min([a3, {_sql_edit('a2', '3', 'I', "'assistant:'")}, {_sql_edit('a0', '6', 'II', "'user:'", "'assistant:'")},
      {_sql_edit('a1', '6', 'II', "'user:'", "'assistant:'")}])
  FROM (
    SELECT conv_id, pos, {_sql_edit('s0', '4', 'D')} AS a0,
      list_min([{_sql_edit('s1', '4', 'D')}, CASE WHEN initial = 's' AND fault NOT IN (1, 2)
        THEN {_sql_edit('s0', 'cut', 'K', 'line')} ELSE {_sql_edit('s1', '4', 'D')} END]) AS a1,
      list_min([{_sql_edit('s2', '4', 'D')}, {_sql_keep('s0', 'u', 'user')}, {_sql_keep('s1', 'u', 'user')},
        {_sql_keep('s3', 'u', 'user')}]) AS a2,
      list_min([{_sql_edit('s3', '4', 'D')}, {_sql_keep('s2', 'a', 'assistant')}]) AS a3
    FROM (
      SELECT j.*, s0, s1, s2, s3, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS cut FROM step
      JOIN judged j ON j.conv_id IS NOT DISTINCT FROM step.conv_id AND j.pos = step.pos + 1))),
best AS (
  SELECT faults.*, list_min([s0, s3]) AS best FROM faults
  JOIN step ON step.conv_id IS NOT DISTINCT FROM faults.conv_id AND step.pos = faults.n)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost,
  coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
"""


# --- op13 -----------------------------------------------------------------------------------------------------------

def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op13_pair_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = word_vocabulary()
    docs = _table(spark, folder, "documents").select(
        "doc_id", pair_bpe.encode(spark, F.col("text"), path).alias("ids"))
    docs = docs.withColumn("decoded", pair_bpe.decode(spark, F.col("ids"), path))
    return docs.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_vectors": op1_near_vectors, "op2_jaccard_join": op2_jaccard_join, "op3_warc": op3_warc,
        "op4_licences": op4_licences, "op5_chat_events": op5_chat_events, "op6_decontamination": op6_decontamination,
        "op7_packing": op7_packing, "op8_ppm": op8_ppm, "op9_quality": op9_quality, "op10_line_dedup": op10_line_dedup,
        "op11_filter_audit": op11_filter_audit, "op12_turn_repair": op12_turn_repair,
        "op13_pair_bpe": op13_pair_bpe,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_vectors": OP1_SQL, "op2_jaccard_join": OP2_SQL, "op3_warc": OP3_SQL, "op5_chat_events": OP5_SQL,
        "op10_line_dedup": OP10_SQL, "op11_filter_audit": OP11_SQL, "op12_turn_repair": OP12_SQL,
    }
