"""Memory pages, links, ranking and prompts over the documents; user memories over the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnloom.catalog.classify_queries import FRAMES
from turnloom.catalog.compress_queries import memory_sql
from turnloom.catalog.registry import lit, query
from turnloom.catalog.tables import SOURCES_SQL, conversations, sources
from turnloom.catalog.data_words import TEST
from turnloom.catalog.turn_queries import _LEAD, _TITLE_SQL
from turnloom.operators import memory as op
from turnloom.operators import profiles
from turnloom.operators import recall as rank
from turnloom.operators.carry_over import frame_sources, memory_trigger
from turnloom.operators.classify import classify, last_frames
from turnloom.operators.compress import memory_frames
from turnloom.sources.io import read_table

_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'untitled')"
_TRIM = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"

_SECTIONS = f"""
s0 AS ({SOURCES_SQL}), s AS (SELECT * REPLACE ({_TRIM.format('content')} AS content) FROM s0 WHERE {_TRIM.format('content')} <> ''),
h AS (SELECT *, left(array_to_string(list_filter(string_split({_LEAD.replace('text', 'content')}, chr(1)), lambda p: p <> '')[1:10], ' '), 700) AS head FROM s),
m AS (SELECT *, CASE WHEN head = '' THEN left(content, 700) ELSE head END AS summary,
  list('- ' || source_id || ': ' || title) OVER (PARTITION BY owner ORDER BY seq ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS trail FROM h),
c0 AS (SELECT owner, seq, list_concat([title], regexp_extract_all(content, '\\b[A-Z][a-zA-Z0-9]+(?:\\s+[A-Z][a-zA-Z0-9]+){{0,3}}\\b'),
  list_filter(regexp_extract_all(lower(content), '\\b[a-z][a-z0-9-]{{3,}}\\b'), lambda t: length(t) > 6)) AS l FROM s),
c1 AS (SELECT owner, seq, unnest(l) AS r, generate_subscripts(l, 1) AS i FROM c0),
c2 AS (SELECT owner, seq, {_TITLE_SQL.format('r')} AS concept, min(i) AS i FROM c1 GROUP BY ALL),
c3 AS (SELECT owner, seq, concept, min(i) AS i FROM c2 WHERE length(concept) > 2 GROUP BY ALL),
c4 AS (SELECT *, row_number() OVER (PARTITION BY owner, seq ORDER BY i) AS rn FROM c3),
sec AS (
  SELECT owner, 'overview.md' AS path, 'Overview' AS title, seq, 0 AS ord, source_id, added_at, ['overview', domain, intent] AS tags,
    array_to_string(['# Overview', '', 'Latest source: [[' || title || ']]', 'Routed domain: [[Domain: ' || domain || ']]',
      'Routed intent: ' || intent, '', '## Current synthesis', summary, '', '## Source trail', array_to_string(trail, chr(10))], chr(10)) AS markdown FROM m
  UNION ALL
  SELECT owner, 'domains/' || {_SLUG.format('domain')} || '.md', 'Domain: ' || domain, seq, 1, source_id, added_at, ['domain', domain],
    array_to_string(['# Domain: ' || domain, '', 'Intent observed: ' || intent, 'State observed: ' || state, '', '## New evidence', summary, '',
      'Sources: ' || source_id], chr(10)) FROM m
  UNION ALL
  SELECT m.owner, 'concepts/' || {_SLUG.format('c4.concept')} || '.md', c4.concept, m.seq, 1 + c4.rn, m.source_id, m.added_at, ['concept', m.domain],
    array_to_string(['# ' || c4.concept, '', 'Related domain: [[Domain: ' || m.domain || ']]', '', '## Notes', m.summary, '', 'Sources: ' || m.source_id], chr(10))
  FROM m JOIN c4 ON c4.owner = m.owner AND c4.seq = m.seq WHERE c4.rn <= 4)"""

_PAGES = f"""WITH {_SECTIONS},
tg AS (SELECT owner, path, tag, min(place) AS place FROM (SELECT owner, path, unnest(tags) AS tag, seq * 1000 + ord * 10 + generate_subscripts(tags, 1) AS place FROM sec) GROUP BY ALL),
tl AS (SELECT owner, path, list(tag ORDER BY place) AS tags FROM tg GROUP BY ALL),
pg AS (SELECT owner, path, arg_max(title, seq * 1000 + ord) AS title, max(added_at) AS updated_at, min(seq * 1000 + ord) AS first,
  count(*) AS n_sections, count(DISTINCT source_id) AS n_sources FROM sec GROUP BY ALL),
pages2 AS (SELECT pg.*, tl.tags FROM pg JOIN tl ON tl.owner = pg.owner AND tl.path = pg.path)"""


def sections(spark, path):
    return op.page_sections(sources(spark, path))


@query("page_sections", f"WITH {_SECTIONS} SELECT owner, path, title, seq, CAST(ord AS BIGINT) AS ord, md5(markdown) AS markdown_md5 FROM sec")
def page_sections(spark, path):
    return sections(spark, path).select(
        "owner", "path", "title", "seq", F.col("ord").cast("long").alias("ord"), F.md5("markdown").alias("markdown_md5")
    )


@query(
    "source_trail",
    f"""WITH s AS ({SOURCES_SQL}) SELECT owner, seq, array_to_string(list(source_id) OVER (PARTITION BY owner ORDER BY seq
ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), '|') AS trail FROM s""",
)
def source_trail(spark, path):
    trail = op.source_trail(sources(spark, path), 6)
    return trail.select("owner", "seq", F.array_join(F.transform("trail", lambda t: t["source_id"]), "|").alias("trail"))


@query(
    "memory_pages",
    f"{_PAGES} SELECT owner, path, title, updated_at, n_sections, n_sources, array_to_string(tags, '|') AS tags FROM pages2",
)
def memory_pages(spark, path):
    return op.merge_pages(op.page_sections(sources(spark, path), with_text=False)).select(
        "owner", "path", "title", "updated_at", "n_sections", "n_sources", F.array_join("tags", "|").alias("tags")
    )


@query(
    "page_text",
    f"""{_PAGES}, n AS (SELECT owner, path, md5(string_agg(markdown, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY seq, ord)) AS text_md5 FROM sec GROUP BY owner, path),
si AS (SELECT owner, path, source_id, min(seq * 1000 + ord) AS place FROM sec GROUP BY ALL),
sl AS (SELECT owner, path, md5(string_agg(source_id, '|' ORDER BY place)) AS sources_md5 FROM si GROUP BY ALL)
SELECT p.owner, p.path, p.title, n.text_md5, sl.sources_md5 FROM pages2 p JOIN n ON n.owner = p.owner AND n.path = p.path JOIN sl ON sl.owner = p.owner AND sl.path = p.path""",
)
def page_text(spark, path):
    """Whole pages with their text and the ids of their sources."""
    pages = op.whole_pages(sections(spark, path))
    return pages.select("owner", "path", "title", F.md5("markdown").alias("text_md5"), F.md5(F.array_join("source_ids", "|")).alias("sources_md5"))


@query(
    "merged_log",
    f"""WITH s0 AS ({SOURCES_SQL}) SELECT row_number() OVER (ORDER BY owner, seq) - 1 AS position, owner, seq FROM s0""",
)
def merged_log(spark, path):
    return op.merged_log(sources(spark, path)).select("position", "owner", "seq")


@query(
    "page_index",
    f"""{_PAGES} SELECT owner, path, '- [' || path || '] ' || title || ' — ' || array_to_string(tags, ', ') || ' — ' || n_sources || ' source(s)' AS line FROM pages2""",
)
def page_index(spark, path):
    return op.page_index(op.merge_pages(op.page_sections(sources(spark, path), with_text=False)))


@query(
    "page_heads",
    f"""WITH {_SECTIONS}, j AS (SELECT owner, path, string_agg(markdown, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY seq, ord) AS t FROM sec GROUP BY ALL)
SELECT owner, path, md5(left(t, 1200)) AS head_md5 FROM j""",
)
def page_heads(spark, path):
    return op.page_heads(sections(spark, path)).select("owner", "path", F.md5("head").alias("head_md5"))


@query(
    "broken_links",
    f"""{_PAGES}, k AS (SELECT DISTINCT owner, unnest(regexp_extract_all(markdown, '\\[\\[([^\\]]+)\\]\\]', 1)) AS title FROM sec)
SELECT k.owner, 'Missing page for link: ' || k.title AS issue FROM k ANTI JOIN pages2 p ON p.owner = k.owner AND p.title = k.title""",
)
def broken_links(spark, path):
    s = sections(spark, path)
    return op.broken_links(s, op.merge_pages(s))


@query(
    "lint_report",
    f"""{_PAGES}, k AS (SELECT DISTINCT owner, unnest(regexp_extract_all(markdown, '\\[\\[([^\\]]+)\\]\\]', 1)) AS title FROM sec),
i AS (SELECT k.owner, 'Missing page for link: ' || k.title AS issue FROM k ANTI JOIN pages2 p ON p.owner = k.owner AND p.title = k.title)
SELECT o.owner, coalesce(i.issue, 'No issues.') AS issue FROM (SELECT DISTINCT owner FROM sec) o LEFT JOIN i ON i.owner = o.owner""",
)
def lint_report(spark, path):
    s = sections(spark, path)
    return op.lint_report(s, op.merge_pages(s))


@query("list_namespaces", "SELECT DISTINCT source AS owner FROM documents")
def list_namespaces(spark, path):
    return op.list_namespaces(sources(spark, path))


@query(
    "merge_namespaces",
    f"""{_PAGES}, o AS (SELECT owner, count(*) AS n, max(added_at) AS u FROM s0 GROUP BY owner)
SELECT CAST(sum(n) AS BIGINT) AS n_sources, max(n) + 1 AS version, max(u) AS last_updated, count(*) AS n_namespaces,
(SELECT count(*) FROM pages2) AS n_pages FROM o""",
)
def merge_namespaces(spark, path):
    return op.merge_namespaces(sources(spark, path), op.merge_pages(op.page_sections(sources(spark, path), with_text=False)))


@query(
    "ingest_log",
    f"""WITH s AS ({SOURCES_SQL}) SELECT owner, seq, chr(10) || '## [' || strftime(added_at, '%Y-%m-%d') || '] ingest | ' || title || chr(10) ||
'- Source: ' || source_id || chr(10) || '- Routed as: ' || intent || ' / ' || domain || ' / ' || state || chr(10) || '- Method: template' || chr(10) AS entry FROM s""",
)
def ingest_log(spark, path):
    return op.ingest_log(sources(spark, path))


def recall_queries(spark, path):
    q = read_table(spark, path, "benchmark")
    return q.select(F.col("item_id").alias("query_id"), F.lit(None).cast("string").alias("owner"), "text")


_TOKENS = "SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '\\b[a-z][a-z0-9-]{3,}\\b')) AS token FROM benchmark"

_RECALL = f"""hay AS (SELECT pages2.owner, pages2.path, pages2.updated_at, pages2.tags,
  lower(pages2.owner || ' ' || pages2.path || ' ' || pages2.title || ' ' || array_to_string(pages2.tags, ' ') || ' ' || b.body) AS hay
  FROM pages2 JOIN (SELECT owner, path, string_agg(markdown, chr(10)) AS body FROM sec GROUP BY ALL) b ON b.owner = pages2.owner AND b.path = pages2.path),
q AS ({_TOKENS}), hit AS (SELECT q.query_id, h.owner, h.path, count(*) AS n FROM q JOIN hay h ON contains(h.hay, q.token) GROUP BY ALL),
sc AS (SELECT b.item_id AS query_id, h.owner, h.path, h.updated_at, coalesce(hit.n, 0) + 3 * len(list_filter(h.tags, lambda t: contains(lower(b.text), lower(t)))) AS score
  FROM benchmark b CROSS JOIN hay h LEFT JOIN hit ON hit.query_id = b.item_id AND hit.owner = h.owner AND hit.path = h.path),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, updated_at DESC, owner, path) AS rank FROM sc WHERE score > 0)
SELECT query_id, rank, owner, path, CAST(score AS BIGINT) AS score FROM rk WHERE rank <= 4"""


@query(
    "recall_top_pages",
    f"{_PAGES}, {_RECALL}",
)
def recall_top_pages(spark, path):
    return rank.recall(recall_queries(spark, path), rank.write_index(sections(spark, path)))


OWNERS = 20  # owners of the supplied sources: src0 to src19


def owned_queries(spark, path):
    q = read_table(spark, path, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return q.withColumn("owner", F.concat(F.lit("src"), (F.col("query_id") % OWNERS).cast("string"))).select("query_id", "owner", "text")


_RANK = f"""{_PAGES}, q AS (SELECT item_id AS query_id, 'src' || (item_id % {OWNERS}) AS owner, lower(text) AS low FROM benchmark),
bt AS (SELECT owner, path, token, count(*) AS n FROM (SELECT owner, path, unnest(regexp_extract_all(lower(markdown), '\\b[a-z][a-z0-9-]{{3,}}\\b')) AS token FROM sec) GROUP BY ALL),
bh AS (SELECT q.query_id, bt.path, least(5, sum(bt.n)) AS n FROM q JOIN bt ON bt.owner = q.owner AND contains(q.low, bt.token) GROUP BY ALL),
sc AS (SELECT q.query_id, p.owner, p.path, p.updated_at, p.first, coalesce(bh.n, 0)
  + len(list_filter(regexp_extract_all(lower(p.title), '\\b[a-z][a-z0-9-]{{3,}}\\b'), lambda t: contains(q.low, t)))
  + len(list_filter(p.tags, lambda t: contains(q.low, lower(t)))) AS score
  FROM q JOIN pages2 p ON p.owner = q.owner LEFT JOIN bh ON bh.query_id = q.query_id AND bh.path = p.path),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, updated_at DESC, first) AS rank FROM sc)"""


@query("context_pages", f"{_RANK} SELECT query_id, rank, owner, path, CAST(score AS BIGINT) AS score FROM rk WHERE rank <= 4")
def context_pages(spark, path):
    return rank.rank_pages(owned_queries(spark, path), rank.write_index(sections(spark, path)))


@query(
    "context_block",
    f"""{_RANK}, j AS (SELECT owner, path, left(string_agg(markdown, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY seq, ord), 1200) AS head FROM sec GROUP BY ALL)
SELECT rk.query_id, md5('LLM Wiki context:' || chr(10) || chr(10) || string_agg('## ' || rk.path || chr(10) || j.head, chr(10) || chr(10) ORDER BY rk.rank)) AS context_md5
FROM rk JOIN j ON j.owner = rk.owner AND j.path = rk.path WHERE rk.rank <= 4 GROUP BY rk.query_id""",
)
def context_block(spark, path):
    index = rank.write_index(sections(spark, path))
    q = owned_queries(spark, path)
    block = rank.context_block(rank.rank_pages(q, index), op.page_heads(index.sections), q, "LLM Wiki context:", "", with_owner=False)
    return block.select("query_id", F.md5("context").alias("context_md5"))


def new_sources(spark, path):
    q = owned_queries(spark, path)
    return q.select(
        "owner",
        F.concat(F.lit("new-"), F.col("query_id").cast("string")).alias("source_id"),
        F.lit("fresh").alias("title"),
        F.col("text").alias("content"),
        F.lit("general").alias("domain"),
        F.lit("generation").alias("intent"),
        F.lit("opening").alias("state"),
    )


_RELATED = f"""{_PAGES}, q AS (SELECT 'new-' || item_id AS source_id, 'src' || (item_id % {OWNERS}) AS owner, text || ' fresh' AS text FROM benchmark),
tk AS (SELECT source_id, owner, token, count(*) AS n FROM (SELECT source_id, owner, unnest(regexp_extract_all(lower(text), '\\b[a-z][a-z0-9-]{{3,}}\\b')) AS token FROM q) GROUP BY ALL),
body AS (SELECT owner, path, lower(string_agg(markdown, chr(10))) AS b FROM sec GROUP BY ALL),
sc AS (SELECT q.source_id, p.owner, p.path, p.first, coalesce(sum(tk.n), 0) AS score FROM q JOIN pages2 p ON p.owner = q.owner
  JOIN body ON body.owner = p.owner AND body.path = p.path LEFT JOIN tk ON tk.source_id = q.source_id AND contains(body.b, tk.token) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, first) AS rank FROM sc)"""


@query(
    "related_pages",
    f"""{_RELATED}
SELECT source_id, rank, owner, path, CAST(score AS BIGINT) AS score FROM rk WHERE rank <= 3""",
)
def related_pages(spark, path):
    return rank.related_pages(new_sources(spark, path), rank.write_index(sections(spark, path)))


@query(
    "ingest_prompt",
    f"""{_RELATED},
hd AS (SELECT owner, path, left(string_agg(markdown, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY seq, ord), {rank.RELATED_CHARS}) AS head FROM sec GROUP BY ALL),
bl AS (SELECT rk.source_id, string_agg('### ' || rk.path || chr(10) || hd.head, chr(10) ORDER BY rk.rank) AS blocks FROM rk
  JOIN hd ON hd.owner = rk.owner AND hd.path = rk.path WHERE rk.rank <= 3 GROUP BY rk.source_id),
ix AS (SELECT owner, left('# Index' || chr(10) || chr(10) || string_agg('- [' || path || '] ' || title || ' — ' || array_to_string(tags, ', ') || ' — ' || n_sources || ' source(s)',
  chr(10) ORDER BY path), 600) AS head FROM pages2 GROUP BY owner),
nw AS (SELECT 'new-' || item_id AS source_id, 'src' || (item_id % {OWNERS}) AS owner, text AS content FROM benchmark)
SELECT nw.source_id, concat_ws(chr(10), {lit(rank.INSTRUCTIONS[0])}, 'general / generation / opening', '## Index', coalesce(ix.head, 'none'), '## Related pages' || chr(10) || bl.blocks,
  '## Source: fresh', left(content, {rank.SOURCE_CHARS}), {lit(rank.INSTRUCTIONS[1].replace('{words}', str(rank.PAGE_WORDS)))}) AS prompt
FROM nw LEFT JOIN ix ON ix.owner = nw.owner LEFT JOIN bl ON bl.source_id = nw.source_id""",
)
def ingest_prompt(spark, path):
    return rank.ingest_prompt(new_sources(spark, path), rank.write_index(sections(spark, path)))


_REMEMBERED = _SECTIONS[: _SECTIONS.index("sec AS (")].replace("[1:10], ' '), 700)", "[1:8], ' '), 900)").replace("left(content, 700)", "left(content, 900)").replace(
    "ROWS BETWEEN 5 PRECEDING", "ROWS BETWEEN 7 PRECEDING"
).replace("list_concat([title], regexp_extract_all(content,", "list_concat(regexp_extract_all(title || chr(10) || content,").replace(
    "regexp_extract_all(lower(content),", "regexp_extract_all(lower(title || chr(10) || content),"
)


@query(
    "remembered_sections",
    f"""WITH {_REMEMBERED}
sec AS (SELECT owner, 'overview.md' AS path, 'Overview' AS title, seq, 0 AS ord, array_to_string(['# Overview', '', 'Latest source: ' || title, '', '## Current synthesis',
    summary, '', '## Source trail', array_to_string(trail, chr(10))], chr(10)) AS markdown FROM m
  UNION ALL SELECT m.owner, 'concepts/' || {_SLUG.format('c4.concept')} || '.md', c4.concept, m.seq, c4.rn,
    array_to_string(['# ' || c4.concept, '', '## Notes', m.summary, '', 'Sources: ' || m.source_id], chr(10)) FROM m JOIN c4 ON c4.owner = m.owner AND c4.seq = m.seq WHERE c4.rn <= 5)
SELECT owner, path, title, seq, ord, md5(markdown) AS markdown_md5 FROM sec""",
)
def remembered_sections(spark, path):
    return op.remember(sources(spark, path)).select("owner", "path", "title", "seq", F.col("ord").cast("long").alias("ord"), F.md5("markdown").alias("markdown_md5"))


@query(
    "recall_remembered",
    f"""WITH {_REMEMBERED}
sec AS (SELECT owner, 'overview.md' AS path, 'Overview' AS title, seq, 0 AS ord, source_id, added_at, ['memory', domain, intent] AS tags,
    array_to_string(['# Overview', '', 'Latest source: ' || title, '', '## Current synthesis', summary, '', '## Source trail', array_to_string(trail, chr(10))], chr(10)) AS markdown FROM m
  UNION ALL SELECT m.owner, 'concepts/' || {_SLUG.format('c4.concept')} || '.md', c4.concept, m.seq, c4.rn, m.source_id, m.added_at, ['memory', m.domain, m.intent],
    array_to_string(['# ' || c4.concept, '', '## Notes', m.summary, '', 'Sources: ' || m.source_id], chr(10)) FROM m JOIN c4 ON c4.owner = m.owner AND c4.seq = m.seq WHERE c4.rn <= 5),
{_PAGES[_PAGES.index("tg AS ("):]}, {_RECALL}""",
)
def recall_remembered(spark, path):
    """What queries recall from the namespaces that sources were remembered in."""
    return rank.recall(recall_queries(spark, path), rank.write_index(op.remember(sources(spark, path))))


@query(
    "generated_sections",
    f"""WITH s AS ({SOURCES_SQL}) SELECT owner, seq, 'notes/p-' || (seq % 9) || '.md' AS path, 'P ' || (seq % 9) AS title, md5({_TRIM.format("content")}) AS markdown_md5
FROM s WHERE {_TRIM.format("content")} <> ''""",
)
def generated_sections(spark, path):
    raw = F.concat(
        F.lit("PAGE: /notes/p "), (F.col("seq") % 9).cast("string"), F.lit("\n"), "content", F.lit("\nPAGE: empty.md\n  \nPAGE: nobody")
    )
    out = op.generated_sections(sources(spark, path).withColumn("raw", raw))
    return out.select("owner", "seq", "path", "title", F.md5("markdown").alias("markdown_md5"))


def sessions(spark, path):
    turns = conversations(spark, path)
    return turns.select("conv_id").distinct().select(
        "conv_id", F.concat(F.lit("u"), (F.col("conv_id") % 7).cast("string")).alias("user_id"), F.col("conv_id").alias("seq")
    )


def _seen(words) -> str:
    return "bool_or(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


def _first(phrase) -> str:
    opening, most = phrase
    found = f"regexp_extract(joined, '{opening}\\s+([^.\\n]{{{profiles.LEAST_CHARS},{most}}})', 1)"
    return f"nullif({_TRIM.format(found)}, '')"


def _listed(*items: str) -> str:
    cleaned = "list_transform(list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL), lambda x: left(trim(regexp_replace(x, '\\s+', ' ', 'g')), 90))"
    return f"list_filter({cleaned}, lambda x: x <> '')"


_DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


def _kept(name: str) -> str:
    added = f"list_concat(uf.{name}, list_filter({_DISTINCT.format(f'uk.{name}')}, lambda x: NOT list_contains(uf.{name}, x)))"
    return f"list_slice({added}, greatest(1, len({added}) - {profiles.LIST_SIZES[name] - 1}), len({added})) AS {name}"


_TITLES = {"profile": "Profile", "patterns": "Patterns", "active_context": "Active context", "mistakes": "Recurring blockers", "behavioral_signals": "Behavioral signals"}
_CONTEXT = ", ".join(
    f"CASE WHEN len({c}) > 0 THEN '{t}:' || chr(10) || array_to_string(list_transform({c}, lambda v: '- ' || v), chr(10)) END" for c, t in _TITLES.items()
)
_USER_SQL = f"""{FRAMES.replace('WITH ', 'WITH RECURSIVE ', 1)},
lf AS (SELECT conv_id, domain, intent FROM frames QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
uj AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS joined, {", ".join(f"{_seen(w)} AS p{i}" for i, (w, _) in enumerate(profiles.PREFERENCES))},
  {", ".join(f"{_seen(w)} AS b{i}" for i, (w, _) in enumerate(profiles.BLOCKERS))} FROM t GROUP BY conv_id),
uk AS (SELECT 'u' || (conv_id % 7) AS user_id, row_number() OVER (PARTITION BY conv_id % 7 ORDER BY conv_id) AS k,
  {_listed("'profile_fact: ' || " + _first(profiles.STUDY))} AS profile,
  {_listed("'common_domain: ' || domain", "'recent_intent: ' || intent")} AS patterns,
  {_listed("'current_work: ' || " + _first(profiles.WORK))} AS active_context,
  {_listed(*[f"CASE WHEN b{i} THEN '{x}' END" for i, (_, x) in enumerate(profiles.BLOCKERS)])} AS mistakes,
  {_listed(*[f"CASE WHEN p{i} THEN '{x}' END" for i, (_, x) in enumerate(profiles.PREFERENCES)])} AS behavioral_signals FROM uj JOIN lf USING (conv_id)),
uf AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, {", ".join(f"CAST([] AS VARCHAR[]) AS {c}" for c in profiles.LIST_SIZES)} FROM uk
  UNION ALL SELECT uk.user_id, uk.k, {", ".join(_kept(c) for c in profiles.LIST_SIZES)} FROM uf JOIN uk ON uk.user_id = uf.user_id AND uk.k = uf.k + 1)
SELECT user_id, k AS version, concat_ws(chr(10), {_CONTEXT}) AS context FROM uf QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1"""


@query("user_memory", _USER_SQL)
def user_memory(spark, path):
    turns = conversations(spark, path)
    folded = profiles.ingest_sessions(turns, last_frames(classify(turns, vocab=TEST)), sessions(spark, path))
    return folded.select("user_id", F.col("version").cast("long").alias("version"), profiles.memory_context().alias("context"))


_LISTS = {"profile": (10, 13, 4), "patterns": (12, 5, 3), "active_context": (8, 11, 9), "mistakes": (8, 3, 2), "behavioral_signals": (12, 29, 14)}


def _pushed(name):
    _, cycle, n = _LISTS[name]
    return f"list_transform(range({n}), lambda i: '{name}' || ((doc_id // 40) * {n} + i * 7) % {cycle})"


def _folded(name):
    added = f"list_concat(f.{name}, list_filter(list_distinct_in_order(n.{name}), lambda x: NOT list_contains(f.{name}, x)))"
    return f"list_slice({added}, greatest(1, len({added}) - {_LISTS[name][0] - 1}), len({added})) AS {name}"


_FOLD_SQL = f"""WITH RECURSIVE n AS (SELECT source AS user_id, doc_id AS seq, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k,
  {", ".join(f"{_pushed(c)} AS {c}" for c in _LISTS)} FROM documents),
f AS (SELECT user_id, k, seq, {", ".join(f"CAST([] AS VARCHAR[]) AS {c}" for c in _LISTS)} FROM n WHERE false
  UNION ALL SELECT user_id, 0, 0, {", ".join("[]" for _ in _LISTS)} FROM (SELECT DISTINCT source AS user_id FROM documents)
  UNION ALL SELECT n.user_id, n.k, n.seq, {", ".join(_folded(c) for c in _LISTS)} FROM f JOIN n ON n.user_id = f.user_id AND n.k = f.k + 1)
SELECT user_id, k AS version, seq AS last_seq, {", ".join(f"array_to_string({c}, '|') AS {c}" for c in _LISTS)}
FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1"""
for _name in _LISTS:
    _FOLD_SQL = _FOLD_SQL.replace(f"list_distinct_in_order(n.{_name})", _DISTINCT.format(f"n.{_name}"))


@query("user_lists", _FOLD_SQL)
def user_lists(spark, path):
    """The fold of five lists over the documents of a source, some with more new items than a list holds."""
    step = F.floor(F.col("doc_id") / 40)

    def pushed(name):
        _, cycle, n = _LISTS[name]
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit(name), ((step * n + i * 7) % cycle).cast("string")))

    items = read_table(spark, path, "documents").select(F.col("source").alias("user_id"), F.col("doc_id").alias("seq"), *[pushed(c).alias(c) for c in _LISTS])
    folded = profiles.fold_user_memory(items)
    return folded.select("user_id", F.col("version").cast("long").alias("version"), "last_seq", *[F.array_join(c, "|").alias(c) for c in _LISTS])


def _part(title: str, column: str) -> str:
    return f"CASE WHEN len({column}) > 0 THEN '{title}: ' || array_to_string({column}, ', ') END"


@query(
    "memory_sources",
    f"""WITH {memory_sql(TEST)}, titled AS (SELECT *, 'Session memory — ' || domain || ' (' || CAST(floor((n - 1) / 2) AS BIGINT) || ' turns)' AS title FROM mem)
SELECT CAST(conv_id AS VARCHAR) AS owner, CAST(1 AS BIGINT) AS seq, 'src-' || left(sha256(conv_id || chr(1) || '1' || chr(1) || title), 12) AS source_id, title,
concat_ws(chr(10), 'Domain: ' || domain || ' | Intent: ' || intent || ' | State: ' || state, 'Task: ' || task, CASE WHEN coalesce(user_goal, '') <> '' THEN 'Goal: ' || user_goal END,
  {_part('Entities', 'entities')}, {_part('Constraints', 'constraints')}, {_part('Unresolved', 'unresolved')}, {_part('Risk', 'risk')}) AS content, domain, intent, state FROM titled""",
)
def memory_sources(spark, path):
    return frame_sources(memory_frames(conversations(spark, path), vocab=TEST)).drop("added_at")


@query(
    "memory_trigger",
    f"{FRAMES} SELECT conv_id, turn, state FROM frames WHERE state IN ('closing', 'resolving') AND pos >= 4",
)
def memory_triggers(spark, path):
    return memory_trigger(classify(conversations(spark, path), vocab=TEST)).select("conv_id", "turn", "state")
