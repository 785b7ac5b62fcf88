"""Prefix trie of conversations: every distinct sequence of first turns is a node.

Conversations are cut into blocks of WIDTH turns. A block is a row of turn keys, named by the hash of all turns before it;
rows are range-sharded by (block, name, keys, conversation). A piece of a shard becomes a padded matrix of turn ids: a lexsort
orders its rows, OR-accumulated masks of changed columns mark where nodes start, and reduceat aggregates every depth.

A node that neither touches the first or last row of its piece nor has members that go on behind their block is closed: its
numbers are final. All others are open. They are recombined by their names, which are the hashes of their turns, and what
hangs below them is added along the path of their smallest member, so nothing is gathered or repeated per level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import shuffle_partitions, stored
from turnloom.plans.segments import numbered

WIDTH = 32  # turns of a block
CELLS = 1 << 20  # of a matrix, about
SPAN = 256  # blocks of a conversation that a running sum goes over at once
HEADS, GROUP = 6, 100  # a conversation takes fewer than HEADS turns from the first of its GROUP
NO_IDS = hashlib.sha256(b"").hexdigest()

PARTS = (
    "open boolean, depth long, p1 long, p2 long, q1 long, q2 long, parent long, conv_id long, n_convs long, n_ends long, "
    "n_children long, n_leaves long, turn_len long, total_len long, below_len long, first_end long, ends string"
)


def _keyed(turns: DataFrame) -> DataFrame:
    """conv_id, pos from 0, the two halves of a turn's key and its length. No text travels."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.xxhash64(role, text).alias("k1"),
        F.xxhash64(F.lit(1), text, role).alias("k2"), F.length(text).cast("long").alias("len"),
    )
    order = ["conv_id", "turn", "k1", "k2"]
    cut = slim.repartitionByRange(shuffle_partitions(turns.sparkSession), *order).withColumn("seg", F.spark_partition_id())
    return numbered(stored(cut, "trie-turns"), ["conv_id"], ["turn", "k1", "k2"], "seg")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n) of all conversations and (conv_id, n, pos, k1, k2, len) of their rebuilt turns."""
    own = stored(_keyed(turns).select("conv_id", "pos", "k1", "k2", "len"), "trie-positions")
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("size"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    convs = sizes.select("conv_id", "size", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("first"))
    firsts = sizes.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("first"), F.col("size").alias("first_size"))
    taken = F.least("h", F.coalesce("first_size", F.lit(0)))
    convs = convs.join(firsts, "first", "left").select("conv_id", "first", "h", taken.alias("taken"), "size")
    convs = stored(convs.withColumn("n", F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))), "trie-conversations")
    heads = own.filter((F.col("conv_id") % GROUP == 0) & (F.col("pos") < HEADS - 1)).withColumnRenamed("conv_id", "first")
    lent = convs.filter("taken > 0").select("conv_id", "first", "n", "taken").join(heads, "first").filter("pos < taken")
    rest = own.join(convs.select("conv_id", "h", "taken", "n"), "conv_id").filter("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    columns = ["conv_id", "n", "pos", "k1", "k2", "len"]
    return convs.select("conv_id", "n"), lent.select(columns).union(rest.select(columns))


def _running(rows: DataFrame, sums: dict[str, str], later: bool) -> DataFrame:
    """rows (conv_id, block, ...) with, for each out: aggregate of sums, the aggregate over a conversation's earlier (later)
    blocks. It runs inside spans of SPAN blocks and over one row for each span."""
    order = F.col("block").desc() if later else F.col("block")
    rows = rows.withColumn("span", F.floor(F.col("block") / SPAN))
    inside = Window.partitionBy("conv_id", "span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("conv_id", "span").agg(*(F.expr(e).alias(f"_{c}") for c, e in sums.items()))
    outer = Window.partitionBy("conv_id").orderBy(F.col("span").desc() if later else F.col("span")).rowsBetween(Window.unboundedPreceding, -1)
    over = {c: e.replace(e[e.index("(") + 1 : -1], f"_{c}") for c, e in sums.items()}
    spans = spans.select("conv_id", "span", *(F.coalesce(F.expr(e).over(outer), F.lit(0)).alias(f"_{c}") for c, e in over.items()))
    for c, e in sums.items():
        rows = rows.withColumn(c, F.coalesce(F.expr(e).over(inside), F.lit(0)))
    rows = rows.join(spans, ["conv_id", "span"])
    for c, e in sums.items():
        rows = rows.withColumn(c, F.col(c).bitwiseXOR(F.col(f"_{c}")) if e.startswith("bit_xor") else F.col(c) + F.col(f"_{c}"))
    return rows.drop("span", *(f"_{c}" for c in sums))


def blocks(turns: DataFrame) -> DataFrame:
    """conv_id, n, block, items (pos, x1, x2, len by pos), the name p1, p2 of the turns before and the length of those behind."""
    convs, rows = rebuilt(turns)
    x1 = F.xxhash64("pos", "k1", "k2")
    x2 = F.xxhash64(F.lit(2), "k2", "k1", "pos")
    block = F.floor(F.col("pos") / WIDTH).alias("block")
    items = rows.select("conv_id", "n", block, F.struct("pos", x1.alias("x1"), x2.alias("x2"), "len").alias("item"))
    first = convs.select("conv_id", "n", F.lit(0).cast("long").alias("block"), F.lit(None).cast(items.schema["item"].dataType).alias("item"))
    made = items.union(first).groupBy("conv_id", "n", "block").agg(
        F.array_sort(F.collect_list("item")).alias("items"), F.coalesce(F.expr("bit_xor(item.x1)"), F.lit(0)).alias("b1"),
        F.coalesce(F.expr("bit_xor(item.x2)"), F.lit(0)).alias("b2"), F.coalesce(F.sum("item.len"), F.lit(0)).alias("b_len"),
    )
    made = stored(made, "trie-blocks")
    own = ["conv_id", "n", "block", "items"]
    zero = F.lit(0).cast("long")
    short = made.filter(F.col("n") <= WIDTH).select(*own, zero.alias("p1"), zero.alias("p2"), zero.alias("behind"))
    slim = made.filter(F.col("n") > WIDTH).drop("items")
    slim = _running(slim, {"p1": "bit_xor(b1)", "p2": "bit_xor(b2)"}, later=False)
    slim = _running(slim, {"behind": "sum(b_len)"}, later=True).select("conv_id", "block", "p1", "p2", "behind")
    long = made.filter(F.col("n") > WIDTH).join(slim, ["conv_id", "block"]).select(*own, "p1", "p2", "behind")
    return stored(short.union(long), "trie-rows")


def _matrix(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Columns of a batch of rows; the items as padded matrices."""
    out = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("conv_id", "n", "block", "p1", "p2", "behind")}
    lists = batch.column("items")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    width = max(1, int(sizes.max()))
    at = np.arange(width) < sizes[:, None]
    out["size"], out["at"] = sizes, at
    for c in ("x1", "x2", "len"):
        out[c] = np.zeros((len(sizes), width), np.int64)
        out[c][at] = flat.field(c).to_numpy(zero_copy_only=False)
    return out


def _dense(*columns: np.ndarray) -> np.ndarray:
    """The same small number for equal rows of the columns, in their order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def piece_nodes(m: dict[str, np.ndarray]) -> list[tuple]:
    """Rows of PARTS for the nodes of one piece."""
    rows, width = m["x1"].shape
    ids = np.full((rows, width), -1, np.int64)
    ids[m["at"]] = _dense(m["x1"][m["at"]], m["x2"][m["at"]])
    group = _dense(m["block"], m["p1"], m["p2"])
    order = np.lexsort((m["conv_id"], *ids.T[::-1], group))
    ids, group = ids[order], group[order]
    conv, block, n, size, lens = (m[c][order] for c in ("conv_id", "block", "n", "size", "len"))
    changed = np.ones((rows, width + 1), bool)
    changed[1:, 0] = group[1:] != group[:-1]
    changed[1:, 1:] = ids[1:] != ids[:-1]
    changed = np.logical_or.accumulate(changed, axis=1)
    suffix = np.zeros((rows, width + 1), np.int64)
    suffix[:, 1:] = np.cumsum(lens[:, ::-1], axis=1)[:, ::-1]
    suffix[:, 1:] += m["behind"][order][:, None]
    suffix[:, 0] = suffix[:, 1]
    goes_on = n > (block + 1) * WIDTH
    names = [np.zeros((rows, width + 1), np.int64) for _ in range(2)]
    for name, p, x in zip(names, ("p1", "p2"), ("x1", "x2"), strict=True):
        name[:, 0] = m[p][order]
        name[:, 1:] = m[x][order]
        np.bitwise_xor.accumulate(name, axis=1, out=name)

    levels: list[dict[str, np.ndarray]] = []
    above = None  # node of each row one column before
    for j in range(width + 1):
        starts = np.flatnonzero(changed[:, j])
        ends = np.append(starts[1:], rows)
        stop = size == j
        stop &= ~goes_on if j else block == 0
        level = {
            "start": starts, "end": ends, "conv": np.minimum.reduceat(conv, starts), "count": ends - starts,
            "ends": np.add.reduceat(stop.astype(np.int64), starts), "total": np.add.reduceat(suffix[:, j], starts),
            "open": (starts == 0) | (ends == rows) | (np.add.reduceat(goes_on.astype(np.int64), starts) > 0) | (j == 0),
            "real": np.ones(len(starts), bool) if j == 0 else ids[starts, j - 1] >= 0,
        }
        level["parent"] = starts * 0 if above is None else above[starts]
        for c in ("children", "leaves", "below"):
            level[c] = np.zeros(len(starts), np.int64)
        above = np.cumsum(changed[:, j]) - 1
        levels.append(level)
    for j in range(width, 0, -1):
        level, up = levels[j], levels[j - 1]
        closed = level["real"] & ~level["open"]
        level["leaves"] += closed & (level["ends"] == level["count"])
        level["below"] += np.where(closed, lens[level["start"], j - 1], 0)
        parent = level["parent"][closed]
        np.add.at(up["children"], parent, 1)
        np.add.at(up["leaves"], parent, level["leaves"][closed])
        np.add.at(up["below"], parent, level["below"][closed])

    out = []
    for j, level in enumerate(levels):
        for i in np.flatnonzero(level["real"]).tolist():
            s, e = int(level["start"][i]), int(level["end"][i])
            is_open, depth = bool(level["open"][i]), int(block[s]) * WIDTH + j
            count = int(level["count"][i])
            stopped = conv[s:e][(size[s:e] == j) & ~goes_on[s:e]] if level["ends"][i] else conv[:0]
            ends = ",".join(map(str, stopped.tolist())) if len(stopped) else None
            if j == 0 and depth:  # a node of the block before; its members are counted there
                if level["children"][i]:
                    out.append((True, depth, int(names[0][s, 0]), int(names[1][s, 0]), None, None, None, None, 0, 0, int(level["children"][i]), int(level["leaves"][i]), None, 0, int(level["below"][i]), None, None))
                continue
            up = levels[j - 1] if j else None
            above_open = up is not None and bool(up["open"][level["parent"][i]])
            q1, q2 = (int(x[s, j - 1]) for x in names) if above_open else (None, None)
            parent = int(up["conv"][level["parent"][i]]) if up is not None and not above_open else None
            if not is_open:
                ends = hashlib.sha256(ends.encode()).hexdigest() if ends else NO_IDS
            out.append((
                is_open, depth, int(names[0][s, j]), int(names[1][s, j]), q1, q2, parent, int(level["conv"][i]), count, int(level["ends"][i]),
                int(level["children"][i]), int(level["leaves"][i]), int(lens[s, j - 1]) if j else 0, int(level["total"][i]),
                int(level["below"][i]), int(stopped[0]) if len(stopped) else None, ends,
            ))
    return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_LONGS = ["depth", "p1", "p2", "q1", "q2", "parent", "conv_id", "n_convs", "n_ends", "n_children", "n_leaves", "turn_len", "total_len", "below_len", "first_end"]
_PARTS = pa.schema([("open", pa.bool_()), *((c, pa.int64()) for c in _LONGS), ("ends", pa.string())])


def _pieces(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Runs of sorted rows that are one shard's pieces."""
    for batch in batches:
        for at in range(0, batch.num_rows, max(1, cells // WIDTH)):
            yield batch.slice(at, max(1, cells // WIDTH))


def _parts(rows: DataFrame, cells: int) -> DataFrame:
    order = ["block", "p1", "p2", "items", "conv_id"]
    sharded = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, cells):
            yield _batch(piece_nodes(_matrix(piece)), _PARTS)

    return stored(sharded.mapInArrow(fn, PARTS), "trie-parts")


def _path_sums(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """depth, p1, p2 and what the open nodes (conv_id, depth, leaves, below) add to every node on their members' paths.

    All that an open node adds lies on the path of its smallest member, so a node's sum is that of the members' paths from
    its depth on.
    """
    placed = nodes.filter("depth > 0").withColumn("block", F.floor((F.col("depth") - 1) / WIDTH))
    item = F.struct(((F.col("depth") - 1) % WIDTH).alias("at"), "leaves", "below")
    own = placed.groupBy("conv_id", "block").agg(F.collect_list(item).alias("own"), F.sum("leaves").alias("sum_leaves"), F.sum("below").alias("sum_below"))
    last = placed.groupBy("conv_id").agg(F.max("block").alias("last"))
    paths = rows.join(last, "conv_id").filter("block <= last").join(own, ["conv_id", "block"], "left")
    paths = paths.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("sum_leaves", "sum_below")})
    slim = paths.select("conv_id", "block", "sum_leaves", "sum_below")
    after = _running(slim, {"later_leaves": "sum(sum_leaves)", "later_below": "sum(sum_below)"}, later=True).drop("sum_leaves", "sum_below")
    paths = paths.join(after, ["conv_id", "block"]).select("block", "p1", "p2", "items", "own", "later_leaves", "later_below", "last")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64()) for c in ("depth", "p1", "p2", "leaves", "below")])
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                width = len(r["items"])
                leaves, below = np.zeros(width, np.int64), np.zeros(width, np.int64)
                for x in r["own"] or ():
                    leaves[x["at"]] += x["leaves"]
                    below[x["at"]] += x["below"]
                until = width if r["block"] < r["last"] else max(x["at"] for x in r["own"]) + 1
                leaves, below = (np.cumsum(v[::-1])[::-1] + later for v, later in ((leaves, r["later_leaves"]), (below, r["later_below"])))
                name = r["p1"], r["p2"]
                for j, x in enumerate(r["items"][:until]):
                    name = name[0] ^ x["x1"], name[1] ^ x["x2"]
                    out.append((r["block"] * WIDTH + j + 1, *name, int(leaves[j]), int(below[j])))
            yield _batch(out, schema)

    return paths.mapInArrow(fn, "depth long, p1 long, p2 long, leaves long, below long")


def _end_hashes(parts: DataFrame) -> DataFrame:
    """depth, p1, p2 and the hash of the ids that end at an open node: its pieces come in order and are hashed as they pass."""
    key = ["depth", "p1", "p2"]
    pieces = parts.filter("open AND ends IS NOT NULL").select(*key, "first_end", "ends")
    pieces = pieces.repartition(*key).sortWithinPartitions(*key, "first_end")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((c, pa.int64()) for c in key), ("ends_sha256", pa.string())])
        name, state, out = None, None, []
        for batch in batches:
            for depth, p1, p2, ends in zip(*(batch.column(c).to_pylist() for c in (*key, "ends")), strict=True):
                if (depth, p1, p2) != name:
                    if name is not None:
                        out.append((*name, state.hexdigest()))
                    name, state = (depth, p1, p2), hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
            yield _batch(out, schema)
            out = []
        if name is not None:
            yield _batch([(*name, state.hexdigest())], schema)

    return pieces.mapInArrow(fn, "depth long, p1 long, p2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, cells: int = CELLS) -> DataFrame:
    """A row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256, all as the contract of `op11_prefix_trie` says.

    Turns are ordered by turn, nulls first; turns of the same number by a hash of role and text. Null role and text are empty.
    Repeated rows are turns of their own. Rows without conv_id take no part; without rows there is no node. A text of any
    length is one key and a number; a conversation of any length is cut into blocks. Turns are told apart by 128 bits of hash.
    """
    rows = blocks(turns.select("conv_id", "turn", "role", "text"))
    parts = _parts(rows, cells)
    key = ["depth", "p1", "p2"]
    opened = parts.filter("open").groupBy(*key).agg(
        *(F.sum(c).alias(c) for c in ("n_convs", "n_ends", "n_children", "n_leaves", "total_len", "below_len")),
        *(F.max(c).alias(c) for c in ("turn_len", "q1", "q2")), F.min("conv_id").alias("conv_id"),
    )
    opened = stored(opened, "trie-open")
    own = opened.select(
        *key, "conv_id", (F.col("n_leaves") + (F.col("n_ends") == F.col("n_convs")).cast("long")).alias("leaves"),
        (F.col("below_len") + F.col("turn_len")).alias("below"),
    )
    sums = _path_sums(rows, own).groupBy(*key).agg(F.sum("leaves").alias("leaves"), F.sum("below").alias("below"))
    root = own.groupBy().agg(F.sum("leaves").alias("leaves"), F.sum("below").alias("below"))
    zero = F.lit(0).cast("long")
    sums = sums.union(root.filter("leaves IS NOT NULL").select(*(zero.alias(c) for c in key), "leaves", "below"))
    names = opened.select(F.col("depth").alias("q_depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("of"))
    children = opened.filter("q1 IS NOT NULL").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    whole = opened.drop("n_leaves", "below_len").join(sums, key).join(children.agg(F.count("*").alias("more")), key, "left")
    whole = whole.join(_end_hashes(parts), key, "left").select(
        "conv_id", "depth", "q1", "q2", F.lit(None).cast("long").alias("parent"), "n_convs",
        (F.col("n_children") + F.coalesce("more", zero)).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("total_len") - F.col("below")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"),
    )
    closed = parts.filter("NOT open").select(
        "conv_id", "depth", "q1", "q2", "parent", "n_convs", "n_children", "n_leaves",
        (F.col("total_len") - F.col("below_len")).alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )
    nodes = whole.union(closed).withColumn("q_depth", F.col("depth") - 1)
    inner = nodes.filter("q1 IS NULL").withColumn("of", zero)
    # the root's children may be a large share of all nodes; the root is one row
    top = names.filter("q_depth = 0").select("q_depth", "of")
    under_root = nodes.filter("q1 IS NOT NULL AND depth = 1").join(F.broadcast(top), "q_depth")
    deeper = nodes.filter("q1 IS NOT NULL AND depth > 1").join(names, ["q_depth", "q1", "q2"])
    columns = [
        "conv_id", "depth", F.when(F.col("q1").isNull(), F.col("parent")).otherwise(F.col("of")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    ]
    return inner.select(columns).union(under_root.select(columns)).union(deeper.select(columns))
