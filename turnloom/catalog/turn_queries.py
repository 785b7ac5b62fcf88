"""Turn shaping, token estimates, uniqueness, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.catalog.registry import lit, query
from turnloom.catalog.tables import VALID_TURNS, conversations, documents
from turnloom.catalog.data_words import TEST
from turnloom.functions import text as tx
from turnloom.functions.facts import ordered_distinct
from turnloom.operators import turns as op
from turnloom.operators.relevance import drop_distractors
from turnloom.plans.segments import top_per_group


@query("turns_scan", f"SELECT conv_id, turn, role, length(text) AS n_chars FROM {VALID_TURNS}")
def turns_scan(spark, path):
    return op.valid_turns(conversations(spark, path)).select(
        "conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars")
    )


_SPLIT = f"""
WITH h AS (
  SELECT conv_id, arg_min(CASE WHEN role = 'system' THEN text END, CASE WHEN role = 'system' THEN turn END) AS system_text,
    max(CASE WHEN role = 'user' THEN turn END) AS current_turn,
    arg_max(CASE WHEN role = 'user' THEN text END, CASE WHEN role = 'user' THEN turn END) AS current_text
  FROM conversations GROUP BY conv_id),
n AS (SELECT h.conv_id, count(*) - 1 AS n_history FROM h JOIN (SELECT * FROM {VALID_TURNS}) t
  ON t.conv_id = h.conv_id AND t.turn <= h.current_turn GROUP BY h.conv_id)
SELECT h.conv_id, h.system_text, h.current_turn, h.current_text, n.n_history FROM h JOIN n ON n.conv_id = h.conv_id
"""


@query("split_request", _SPLIT)
def split_request(spark, path):
    return op.history_sizes(conversations(spark, path))


@query(
    "assemble_forward",
    f"""
WITH v AS (SELECT * FROM {VALID_TURNS}),
h AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'system') AS sys, arg_max(text, turn) FILTER (WHERE role = 'user') AS cur
  FROM conversations GROUP BY conv_id),
k AS (SELECT conv_id, role, text, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM v) WHERE rn <= 2),
m AS (SELECT conv_id, string_agg(role || ':' || text, chr(10) ORDER BY turn) AS body FROM k GROUP BY conv_id),
p AS (SELECT h.conv_id, bool_or(k.role = 'user' AND k.text = h.cur) AS present FROM h JOIN k ON k.conv_id = h.conv_id GROUP BY h.conv_id)
SELECT h.conv_id, (CASE WHEN h.sys IS NOT NULL THEN 'system:' || h.sys || chr(10) ELSE '' END) || m.body ||
  (CASE WHEN NOT p.present AND h.cur <> '' THEN chr(10) || 'user:' || h.cur ELSE '' END) AS forwarded
FROM h JOIN m ON m.conv_id = h.conv_id JOIN p ON p.conv_id = h.conv_id WHERE h.cur IS NOT NULL
""",
)
def assemble_forward(spark, path):
    turns = conversations(spark, path)
    heads = op.split_request(turns).filter(F.col("current_text").isNotNull())
    last = top_per_group(op.valid_turns(turns), ["conv_id"], [F.col("turn").desc()], 2)
    kept = last.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("kept"))
    messages = op.forward_messages(F.col("system_text"), F.col("kept"), F.col("current_text"))
    lines = F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    return heads.join(kept, "conv_id").select("conv_id", F.array_join(lines, "\n").alias("forwarded"))


@query(
    "conversation_tokens",
    f"SELECT conv_id, CAST(ceil(sum(length(text)) / 4.0) AS BIGINT) AS tokens FROM {VALID_TURNS} GROUP BY conv_id",
)
def conversation_tokens(spark, path):
    turns = op.valid_turns(conversations(spark, path))
    return turns.groupBy("conv_id").agg(tx.est_tokens(F.sum(F.length("text"))).alias("tokens"))


@query("document_tokens", "SELECT doc_id, CAST(ceil(length(text) / 4.1) AS BIGINT) AS tokens FROM documents")
def document_tokens(spark, path):
    return documents(spark, path).select("doc_id", tx.est_tokens_log(F.col("text")).alias("tokens"))


@query(
    "savings",
    f"""
WITH t AS (SELECT conv_id, CAST(ceil(sum(length(text)) / 4.0) AS BIGINT) AS original,
  CAST(ceil(coalesce(sum(length(text)) FILTER (WHERE role = 'user'), 0) / 4.0) AS BIGINT) AS compressed
  FROM {VALID_TURNS} GROUP BY conv_id)
SELECT conv_id, greatest(0, original - compressed) AS saved,
  CASE WHEN original > 0 THEN round(greatest(0, original - compressed) / original * 100, 1) ELSE 0 END AS pct,
  CASE WHEN original > 0 THEN round(greatest(0, original - compressed) / original * 100, 0) ELSE 0 END AS pct_whole
FROM t
""",
)
def savings(spark, path):
    turns = op.valid_turns(conversations(spark, path))
    user = F.when(F.col("role") == "user", F.length("text")).otherwise(F.lit(0))
    t = turns.groupBy("conv_id").agg(
        tx.est_tokens(F.sum(F.length("text"))).alias("o"), tx.est_tokens(F.sum(user)).alias("c")
    )
    o, c = F.col("o"), F.col("c")
    return t.select(
        "conv_id",
        tx.saved_tokens(o, c).alias("saved"),
        tx.savings_pct(o, c).alias("pct"),
        tx.savings_pct(o, c, 0).alias("pct_whole"),
    )


@query(
    "unique_turns",
    f"SELECT conv_id, min(turn) AS turn, role, text FROM {VALID_TURNS} GROUP BY conv_id, role, text",
)
def unique_turns(spark, path):
    return op.unique_turns(op.valid_turns(conversations(spark, path)))


@query(
    "latest_user_text",
    f"""SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), arg_max(text, turn)) AS latest_text
FROM {VALID_TURNS} GROUP BY conv_id""",
)
def latest_user_text(spark, path):
    return op.latest_user_text(conversations(spark, path))


@query(
    "recency_weight",
    f"""SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
round((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / greatest(1, count(*) OVER (PARTITION BY conv_id)), 9) AS recency
FROM {VALID_TURNS}""",
)
def recency_weight(spark, path):
    return op.recency_weight(conversations(spark, path)).withColumn("recency", F.round("recency", 9))


@query(
    "ordered_distinct",
    """
WITH w AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM
  (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS l FROM documents)),
f AS (SELECT doc_id, w, i, row_number() OVER (PARTITION BY doc_id, lower(w) ORDER BY i) AS rn FROM w WHERE length(w) BETWEEN 2 AND 160)
SELECT doc_id, md5(string_agg(w, ' ' ORDER BY i)) AS words_md5, count(*) AS n_words FROM f WHERE rn = 1 GROUP BY doc_id
""",
)
def ordered_distinct_words(spark, path):
    words = "regexp_extract_all(text, '[A-Za-z]+', 0)"
    listed = documents(spark, path).select("doc_id", F.expr(ordered_distinct(words)).alias("l")).filter(F.size("l") > 0)
    return listed.select("doc_id", F.md5(F.array_join("l", " ")).alias("words_md5"), F.size("l").cast("long").alias("n_words"))


@query(
    "drop_distractors",
    f"""SELECT conv_id, turn FROM {VALID_TURNS} AND NOT regexp_matches(lower(text), {lit(chr(92) + 'b(' + '|'.join(TEST.distractors) + ')' + chr(92) + 'b')})""",
)
def drop_distractor_turns(spark, path):
    return drop_distractors(op.valid_turns(conversations(spark, path)), TEST).select("conv_id", "turn")


_TITLE_SQL = """array_to_string(list_transform(regexp_extract_all(trim(regexp_replace(regexp_replace({0}, '[-_]+', ' ', 'g'), '\\s+', ' ', 'g')),
'[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda p: CASE WHEN regexp_matches(p, '^[a-z]') THEN upper(p[1]) || p[2:] ELSE p END), '')"""


@query(
    "text_functions",
    f"""
SELECT page_id,
  left(trim(regexp_replace(url, '\\s+', ' ', 'g')), 40) AS compacted,
  coalesce(nullif(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'untitled') AS slug,
  {_TITLE_SQL.format('url')} AS titled,
  array_to_string(regexp_extract_all(lower(url), '\\b[a-z][a-z0-9-]{{3,}}\\b'), ' ') AS tokens,
  left(regexp_replace(url, '[^a-zA-Z0-9._:@-]', '-', 'g'), 128) AS account,
  coalesce(nullif(left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9_.-]+', '-', 'g'), '^-|-$', '', 'g'), 80), ''), 'default') AS namespace,
  sha256(url) AS hashed
FROM pages
""",
)
def text_functions(spark, path):
    from turnloom.sources.io import read_table

    url = F.col("url")
    return read_table(spark, path, "pages").select(
        "page_id",
        tx.compact(url, 40).alias("compacted"),
        tx.slug(url).alias("slug"),
        tx.title_case(url).alias("titled"),
        F.array_join(tx.tokenize(url), " ").alias("tokens"),
        tx.account_id(url).alias("account"),
        tx.namespace_id(url).alias("namespace"),
        tx.key_hash(url).alias("hashed"),
    )


_LEAD = "regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g')"


@query(
    "lead_sentences",
    f"""
WITH h AS (SELECT doc_id, text, left(array_to_string(list_filter(string_split({_LEAD}, chr(1)), lambda p: p <> '')[1:10], ' '), 700) AS head FROM documents)
SELECT doc_id, CASE WHEN head = '' THEN left(text, 700) ELSE head END AS summary FROM h
""",
)
def lead_sentences(spark, path):
    return documents(spark, path).select("doc_id", tx.lead_sentences(F.col("text"), 10, 700).alias("summary"))


CONCEPTS_SQL = f"""
WITH c AS (SELECT doc_id, list_concat(['note ' || (doc_id % 50)],
    regexp_extract_all(text, '\\b[A-Z][a-zA-Z0-9]+(?:\\s+[A-Z][a-zA-Z0-9]+){{0,3}}\\b'),
    list_filter(regexp_extract_all(lower(text), '\\b[a-z][a-z0-9-]{{3,}}\\b'), lambda t: length(t) > 6)) AS l FROM documents),
u AS (SELECT doc_id, unnest(l) AS r, generate_subscripts(l, 1) AS i FROM c),
t AS (SELECT doc_id, i, {_TITLE_SQL.format('r')} AS title FROM u),
k AS (SELECT doc_id, title, min(i) AS i FROM t WHERE length(title) > 2 GROUP BY doc_id, title),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM k)
SELECT doc_id, string_agg(title, '|' ORDER BY i) AS concepts FROM n WHERE rn <= 8 GROUP BY doc_id
"""


@query("concepts", CONCEPTS_SQL)
def concept_lists(spark, path):
    title = F.concat(F.lit("note "), (F.col("doc_id") % 50).cast("string"))
    return documents(spark, path).select("doc_id", F.array_join(tx.concepts(F.col("text"), title), "|").alias("concepts"))


@query(
    "long_lines",
    """
SELECT doc_id, md5(array_to_string(list_transform(string_split(regexp_replace(text,
  'data:image/[a-zA-Z]*;base64,[A-Za-z0-9+/=]+', '[BASE64_IMAGE_REMOVED]', 'g'), chr(10)),
  lambda l: CASE WHEN length(l) > 300 THEN left(l, 150) || ' ... [LONG LINE OF ' || length(l) || ' CHARS TRUNCATED] ... ' || right(l, 50) ELSE l END),
  chr(10))) AS shortened_md5 FROM documents
""",
)
def long_lines(spark, path):
    short = tx.shorten_long_lines(tx.strip_images(F.col("text")))
    return documents(spark, path).select("doc_id", F.md5(short).alias("shortened_md5"))
