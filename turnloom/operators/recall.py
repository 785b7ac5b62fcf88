"""Ranking of memory pages through a stored word index.

The index is written once: sections, pages, postings (page, part, terms: what a section or a page holds, repeats included), a
table of terms, and the first characters at every position of every word. A section is read by one pattern, and its
words stay together in a row, so writing shuffles nothing but the pages and the vocabulary.

A ranking keeps only what a query asks for: places where asked terms are found become (page, unit, n). Up to HOT pages these meet
the queries in a join. Beyond that a frequent word would be a row for each page and query, so pages and queries are packed into
blocks of bounded size; a pair of blocks is scored as arrays and gives the k best pages of each query. No page is left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from turnloom.functions.text import tokenize
from turnloom.operators.memory import index_head, merge_pages, page_heads
from turnloom.plans.containment import GRAM, positions, texts_containing, words_of
from turnloom.plans.segments import top_per_group
from turnloom.session import checkpoint_dir, durable

HOT = 4096  # pages
BODY_MOST = 5
PAGES_PER_BLOCK = 1024
QUERIES_PER_BLOCK = 256
AT_ONCE = 1 << 20  # products of a pair of blocks
BROADCAST_ROWS = 1 << 17  # places of units
LAST = (1 << 63) - 1


@dataclass
class MemoryIndex:
    """Stored tables of an index, and three numbers known since they were written."""

    sections: DataFrame
    pages: DataFrame
    postings: DataFrame
    terms: DataFrame
    starts: DataFrame
    n_pages: int
    longest_tag: int
    hot: int


def _runs(text: Column) -> Column:
    """Runs of letters, digits, dashes and underlines, repeats included. A token of the text is a token of one of its runs, as
    nothing beside a run is part of a word; what holds a token as characters is one run."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_-]{%d,}" % GRAM), F.lit(0))


def _page(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), F.col("owner").isNull(), "owner", F.col("path").isNull(), "path")


def write_index(sections: DataFrame, folder: str | None = None, hot: int = HOT) -> MemoryIndex:
    """Write the tables of an index below folder (one of its own in the shared folder, unless given) and open them."""
    spark = sections.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/turnloom-index-{uuid.uuid4().hex}"

    def written(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    sections = written("sections", sections)
    pages = written("pages", merge_pages(sections))
    n_pages, salt = pages.count(), 0
    while pages.select(_page(salt)).distinct().count() < n_pages:  # two pages of one number: others are tried
        salt += 1
    pages = pages.withColumn("page", _page(salt))
    about = F.concat_ws(" ", "owner", "path", "title", F.array_join("tags", " "))
    lists = {"about": _runs(about), "title": tokenize(F.col("title")), "tag": F.filter(F.transform("tags", lambda t: F.lower(t)), lambda t: t != "")}
    parts = F.explode_outer(F.array(*[F.struct(F.lit(part).alias("part"), terms.alias("terms")) for part, terms in lists.items()])).alias("s")
    of_pages = pages.select("page", parts).select("page", "s.part", "s.terms")
    of_text = sections.select(_page(salt).alias("page"), F.lit("text").alias("part"), _runs(F.col("markdown")).alias("terms"))
    postings = written("postings", of_text.unionByName(of_pages))
    found = postings.select("part", F.explode("terms").alias("run")).distinct()
    tokens = found.filter(F.col("part") == "text").select(F.lit("body").alias("part"), F.explode_outer(tokenize(F.col("run"))).alias("term"), "run")
    tokens = tokens.filter(F.col("term").isNotNull()).groupBy("part", "term", "run").agg(F.count(F.lit(1)).alias("n"))
    found = durable(found)
    terms = written("terms", found.select("part", F.col("run").alias("term"), "run", F.lit(1).cast("long").alias("n")).unionByName(tokens))
    vocabulary = found.filter(F.col("part").isin("text", "about")).select(F.col("run").alias("word")).distinct()
    starts = written("starts", positions(vocabulary, "word").select("gram", "word").distinct())
    longest = terms.filter(F.col("part") == "tag").agg(F.max(F.length("term"))).first()[0]
    return MemoryIndex(sections, pages, postings, terms, starts, n_pages, longest or 0, hot)


# --- what a query asks for: (query_id, owner, part, unit, weight), and where a unit is found: (stored, run, part, unit, n) ---


def _asked_tags(queries: DataFrame, index: MemoryIndex, weight: int) -> DataFrame:
    """Tags that occur in the text of a query."""
    tags = index.terms.filter(F.col("part") == "tag").select(F.col("term").alias("needle"))
    texts = queries.select(F.struct("query_id", "owner").alias("of"), F.lower("text").alias("low"))
    return texts_containing(tags, texts, "of", longest=index.longest_tag).select(
        "of.query_id", "of.owner", F.lit("tag").alias("part"), F.col("needle").alias("unit"), F.lit(weight).cast("long").alias("weight")
    )


def _places(index: MemoryIndex, *parts: str) -> DataFrame:
    """Units of the parts are terms themselves."""
    stored = F.when(F.col("part") == "body", F.lit("text")).otherwise(F.col("part"))
    return index.terms.filter(F.col("part").isin(*parts)).select(stored.alias("stored"), "run", "part", F.col("term").alias("unit"), "n")


def _places_of_words(tokens: DataFrame, index: MemoryIndex, *stored: str) -> DataFrame:
    """Tokens are found as part of a word."""
    needles = tokens.select("unit").distinct().withColumn("gram", F.substring("unit", 1, GRAM))
    found = index.starts.join(needles, "gram").filter(F.col("word").contains(F.col("unit"))).select("unit", F.col("word").alias("run")).distinct()
    each = F.explode(F.array(*[F.lit(s) for s in stored])).alias("stored")
    return found.select(each, "run", F.lit("word").alias("part"), "unit", F.lit(1).cast("long").alias("n"))


def _found(index: MemoryIndex, places: DataFrame) -> DataFrame:
    """(page, u, n): pages with a unit, once each. Several words of a page may hold a token of part word, whose u is odd; it
    counts once."""
    held = F.broadcast(places) if places.count() <= BROADCAST_ROWS else places.hint("shuffle_hash")
    rows = index.postings.select("page", F.col("part").alias("stored"), F.explode("terms").alias("run")).join(held, ["stored", "run"])
    n = F.when(F.col("u") % 2 == 1, F.lit(1).cast("long")).otherwise(F.sum("n"))
    return rows.groupBy("page", "u").agg(n.alias("n"))


def _score(most_body: int | None) -> Column:
    value = F.col("weight") * F.col("n")
    if most_body is None:
        return F.sum(value)
    body = F.sum(F.when(F.col("body"), value).otherwise(F.lit(0)))
    return F.sum(F.when(~F.col("body"), value).otherwise(F.lit(0))) + F.least(F.lit(most_body).cast("long"), body)


def _blocks(rows: DataFrame, group: str, name: Column, item: Column, most: int) -> DataFrame:
    """(group, items): the rows of a group dealt by the hash of their name into blocks of about `most`, each in order."""
    sizes = rows.groupBy(F.col(group).alias("of")).agg(F.ceil(F.count(F.lit(1)) / most).cast("long").alias("blocks"))
    placed = rows.join(sizes, F.col(group).eqNullSafe(F.col("of"))).select(group, F.pmod(F.xxhash64(name), "blocks").alias("block"), item.alias("item"))
    return placed.groupBy(group, "block").agg(F.sort_array(F.collect_list("item")).alias("items"))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of an array of lists one after the other, and how many each list has."""
    return column.flatten(), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _products(counts: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of pages whose hits make about AT_ONCE products, one page at least."""
    upto = np.append(0, np.cumsum(counts))[cuts]
    a = 0
    while a < len(cuts) - 1:
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + AT_ONCE, side="right")) - 1)
        yield a, b
        a = b


def _pair_scores(page_hits: tuple, asked: tuple, n_queries: int, most_body: int | None) -> np.ndarray:
    """Scores (pages, queries) of two blocks. page_hits: cuts, units, n, the hits of page i being cuts[i] to cuts[i + 1];
    asked: units in order, queries, weights, and which are of the body. Sums are exact below 2^53."""
    cuts, units, n = page_hits
    wanted, queries, weights, body = asked
    low, high = np.searchsorted(wanted, units, side="left"), np.searchsorted(wanted, units, side="right")
    out = np.zeros((len(cuts) - 1, n_queries), np.int64)
    for a, b in _products(high - low, cuts):
        first, some = low[cuts[a] : cuts[b]], slice(cuts[a], cuts[b])
        counts = (high - low)[some]
        hit = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(hit)) - np.repeat(np.cumsum(counts) - counts, counts) + first[hit]
        page = np.repeat(np.arange(b - a), np.diff(cuts[a : b + 1]))[hit]
        cell, value, in_body = page * n_queries + queries[at], weights[at] * n[some][hit], body[at]
        own, capped = (np.bincount(cell[x], value[x], (b - a) * n_queries).astype(np.int64) for x in (~in_body, in_body))
        out[a:b] = (own + (capped if most_body is None else np.minimum(capped, most_body))).reshape(b - a, n_queries)
    return out


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (page, query) of the k best pages of each query, of equal scores the earlier ones; none with score 0."""
    n = len(scores)
    keys = scores * n + (n - 1 - np.arange(n))[:, None]
    pages = np.argpartition(-keys, min(k, n) - 1, axis=0)[: min(k, n)]
    queries = np.broadcast_to(np.arange(scores.shape[1]), pages.shape)
    hit = scores[pages, queries] > 0
    return pages[hit], queries[hit]


def _block_scores(index: MemoryIndex, found: DataFrame, asked: DataFrame, ties: list[Column], k: int, most_body: int | None) -> DataFrame:
    """(query_id, owner, path, score): the k best pages of each query in each block of pages, those with a hit."""
    rows = found.groupBy("page").agg(F.collect_list(F.struct("u", "n")).alias("hits"))
    rows = rows.join(index.pages.select("page", "owner", "path", "updated_at", "first_seq", "first_ord"), "page")
    ordered = F.struct(*[t.alias(f"t{i}") for i, t in enumerate(ties)], "path", "hits")
    pages = _blocks(rows, "owner", F.col("path"), ordered, PAGES_PER_BLOCK)
    pages = durable(pages.select("owner", F.col("items.path").alias("paths"), F.transform("items", lambda x: F.size(x["hits"])).alias("sizes"), F.flatten("items.hits").alias("hits")))
    of_query = asked.groupBy("query_id", "q_owner").agg(F.collect_list(F.struct("u", "weight", "body")).alias("asked"))
    queries = _blocks(of_query, "q_owner", F.col("query_id"), F.struct("query_id", "asked"), QUERIES_PER_BLOCK)
    queries = durable(
        queries.select(
            "q_owner", F.col("items.query_id").alias("ids"),
            F.sort_array(F.flatten(F.transform("items", lambda x, i: F.transform(x["asked"], lambda a: F.struct(a["u"].alias("u"), i.alias("q"), a["weight"].alias("weight"), a["body"].alias("body")))))).alias("asked"),
        )
    )
    own = pages.join(queries.filter("q_owner IS NOT NULL"), F.col("owner") == F.col("q_owner"))
    pairs = own.unionByName(pages.crossJoin(queries.filter("q_owner IS NULL")))
    out = StructType([asked.schema["query_id"], *pages.select("owner", F.get("paths", F.lit(0)).alias("path")).schema]).add("score", "long")
    schema = to_arrow_schema(out)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                owner, paths, sizes, hits, ids, wanted = (batch.column(c)[i] for c in ("owner", "paths", "sizes", "hits", "ids", "asked"))
                u, n = (hits.values.field(c).to_numpy(zero_copy_only=False) for c in ("u", "n"))
                cuts = np.append(0, np.cumsum(sizes.values.to_numpy(zero_copy_only=False)))
                of = tuple(wanted.values.field(c).to_numpy(zero_copy_only=False) for c in ("u", "q", "weight", "body"))
                scores = _pair_scores((cuts, u, n), of, len(ids), most_body)
                page, query = _best(scores, k)
                columns = [ids.values.take(pa.array(query)), pa.array([owner.as_py()] * len(page)), paths.values.take(pa.array(page)), pa.array(scores[page, query])]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return pairs.select("owner", "paths", "sizes", "hits", "ids", "asked").mapInArrow(scored, out)


def _ranked(index: MemoryIndex, asked: DataFrame, places: DataFrame, k: int, ties: list[Column], most_body: int | None = None, fill: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, owner, path, score): the k best pages of each query; fill(query_id, owner, path) has at least score 0."""
    unit = ["part", "unit"]
    asked = durable(asked.withColumnRenamed("owner", "q_owner"))
    number = F.monotonically_increasing_id() * 2 + F.when(F.col("part") == "word", F.lit(1)).otherwise(F.lit(0))
    units = durable(asked.select(*unit).distinct().withColumn("u", number))
    places = durable(places.join(units, unit).select("stored", "run", "u", "n"))
    found = _found(index, places)
    asked = asked.join(units, unit).select("query_id", "q_owner", "u", "weight", (F.col("part") == "body").alias("body"))
    page = ["query_id", "owner", "path"]
    if index.n_pages <= index.hot:
        hits = found.join(index.pages.select("page", "owner", "path"), "page").join(asked, "u").filter(F.col("q_owner").isNull() | (F.col("q_owner") == F.col("owner")))
        scores = hits.groupBy(*page).agg(_score(most_body).alias("score"))
    else:
        scores = _block_scores(index, found, asked, ties, k, most_body)
    if fill is not None:
        scores = scores.unionByName(fill.select(*page, F.lit(0).cast("long").alias("score"))).groupBy(*page).agg(F.max("score").alias("score"))
    about_page = index.pages.select("owner", "path", "updated_at", "first_seq", "first_ord")
    ranked = top_per_group(scores.join(about_page, ["owner", "path"]), ["query_id"], [F.col("score").desc(), *ties], k)
    return ranked.select("query_id", "rank", "owner", "path", "score")


def _newest() -> Column:
    """Ascending where updated_at descends, pages without a time last."""
    return F.coalesce(-F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(LAST))


def recall(queries: DataFrame, index: MemoryIndex, max_pages: int = 4) -> DataFrame:
    """Ranked pages for queries(query_id, owner, text); a null owner searches every namespace.

    Score: three per tag found in the query, one per distinct query token found anywhere in the page
    (namespace, path, title, tags, text). Pages without a hit are left out; the newest wins a tie.
    """
    tokens = queries.select("query_id", "owner", F.explode_outer(F.array_distinct(tokenize(F.col("text")))).alias("unit"))
    tokens = tokens.filter(F.col("unit").isNotNull()).select("query_id", "owner", F.lit("word").alias("part"), "unit", F.lit(1).cast("long").alias("weight"))
    tags = _asked_tags(queries, index, 3)
    places = _places_of_words(tokens, index, "text", "about").unionByName(_places(index, "tag"))
    return _ranked(index, tokens.unionByName(tags), places, max(1, min(8, max_pages)), [_newest(), F.col("owner"), F.col("path")])


def rank_pages(queries: DataFrame, index: MemoryIndex, max_pages: int = 4) -> DataFrame:
    """Ranked pages of the query's owner for queries(query_id, owner, text).

    Score: tags found in the text, title tokens found, and up to five body tokens found. Pages without
    any hit fill up the list, newest first.
    """
    words = queries.select("query_id", "owner", F.explode_outer(words_of(F.col("text"))).alias("word")).filter(F.col("word").isNotNull())
    needles = index.terms.filter(F.col("part").isin("title", "body")).select(F.col("term").alias("unit")).distinct()
    needles = needles.withColumn("gram", F.substring("unit", 1, GRAM))
    pairs = positions(words.select("word").distinct(), "word").join(needles, "gram").filter(F.col("word").contains(F.col("unit"))).select("word", "unit").distinct()
    asked = words.join(pairs, "word").select("query_id", "owner", "unit").distinct()
    asked = asked.select("query_id", "owner", F.explode(F.array(F.lit("title"), F.lit("body"))).alias("part"), "unit", F.lit(1).cast("long").alias("weight"))
    asked = asked.unionByName(_asked_tags(queries, index, 1))
    newest = top_per_group(index.pages, ["owner"], [_newest(), F.col("first_seq"), F.col("first_ord")], max_pages)
    fill = queries.select("query_id", "owner").join(newest.select("owner", "path"), "owner")
    ties = [_newest(), F.col("first_seq"), F.col("first_ord")]
    return _ranked(index, asked, _places(index, "title", "body", "tag"), max_pages, ties, BODY_MOST, fill)


def related_pages(sources: DataFrame, index: MemoryIndex, k: int = 3) -> DataFrame:
    """For each new source(owner, source_id, title, content) the k pages of its owner that contain most of its tokens.

    Every occurrence of a token in the source counts; earlier pages win a tie and fill up the list.
    """
    text = F.concat("content", F.lit(" "), "title")
    tokens = sources.select(F.col("source_id").alias("query_id"), "owner", F.explode_outer(tokenize(text)).alias("unit")).filter(F.col("unit").isNotNull())
    asked = tokens.groupBy("query_id", "owner", "unit").agg(F.count(F.lit(1)).alias("weight"))
    asked = asked.select("query_id", "owner", F.lit("word").alias("part"), "unit", "weight")
    first = top_per_group(index.pages, ["owner"], [F.col("first_seq"), F.col("first_ord")], k).select("owner", "path")
    fill = sources.select(F.col("source_id").alias("query_id"), "owner").join(first, "owner")
    ties = [F.col("first_seq"), F.col("first_ord")]
    ranked = _ranked(index, asked, _places_of_words(asked, index, "text"), k, ties, fill=fill)
    return ranked.withColumnRenamed("query_id", "source_id")


# --- texts made of ranked pages --------------------------------------------------------------------


def context_block(ranked: DataFrame, heads: DataFrame, queries: DataFrame, title: str, empty: str, with_owner: bool) -> DataFrame:
    """(query_id, context): a heading and the head of each ranked page; a fixed text when there is none."""
    name = F.concat("owner", F.lit("/"), "path") if with_owner else F.col("path")
    block = F.concat(F.lit("## "), name, F.lit("\n"), "head")
    listed = ranked.join(heads, ["owner", "path"]).groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))).alias("l")
    )
    text = F.array_join(F.concat(F.array(F.lit(title)), F.transform("l", lambda s: s["b"])), "\n\n")
    return queries.select("query_id").join(listed, "query_id", "left").select(
        "query_id", F.when(F.col("l").isNotNull(), text).otherwise(F.lit(empty)).alias("context")
    )


#: What a page generator is asked for; PAGE: lines are what generated_sections reads.
INSTRUCTIONS = (
    "Keep the notes of this owner up to date with the source below.",
    "Answer with pages, each beginning with a line PAGE: folder/name.md (overview.md, concepts/..., domains/...), at most "
    "{words} words long. Say what was decided, found or left open, in your own words, and link other pages as [[Title]].",
)
PAGE_WORDS = 400
RELATED_CHARS = 500
SOURCE_CHARS = 2000


def ingest_prompt(
    sources: DataFrame, index: MemoryIndex, instructions: tuple[str, str] = INSTRUCTIONS, words: int = PAGE_WORDS
) -> DataFrame:
    """(source_id, prompt): the text a page generator gets for each new source(owner, source_id, title, content, domain,
    intent, state): task, labels, index, heads of related pages, source, form of the answer."""
    ranked = related_pages(sources, index)
    block = F.concat(F.lit("### "), "path", F.lit("\n"), F.substring("head", 1, RELATED_CHARS))
    related = ranked.join(page_heads(index.sections, RELATED_CHARS), ["owner", "path"]).groupBy("source_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))).alias("l")
    )
    rows = sources.join(related, "source_id", "left").join(index_head(index.pages), "owner", "left")
    blocks = F.array_join(F.transform("l", lambda s: s["b"]), "\n")
    prompt = F.concat_ws(
        "\n",
        F.lit(instructions[0]),
        F.concat_ws(" / ", "domain", "intent", "state"),
        F.lit("## Index"),
        F.coalesce("index_head", F.lit("none")),
        F.when(F.col("l").isNotNull(), F.concat(F.lit("## Related pages\n"), blocks)),
        F.concat(F.lit("## Source: "), "title"),
        F.substring("content", 1, SOURCE_CHARS),
        F.lit(instructions[1].replace("{words}", str(words))),
    )
    return rows.select("source_id", prompt.alias("prompt"))
