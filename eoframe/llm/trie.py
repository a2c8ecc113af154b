"""Prefix trie of conversations: padded matrices of turn ids, sorted and cut into nodes column by column, shard by shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eoframe.llm.tables import count_parts, materialize, running_sums

#: Rebuilding: a conversation begins with up to ``HEADS`` - 1 turns of the first one of its hundred.
HEADS, HUNDRED = 6, 100
#: Turns of a matrix. Longer conversations go on in further windows, keyed by what came before.
WINDOW = 64
#: Rows of a shard.
SHARD = 16384
#: Bytes of a piece of an id list.
PIECE = 1 << 20
EMPTY = hashlib.sha256(b"").hexdigest()

#: What a shard tells of a node. ``open`` nodes have rows in several shards; their parts are added up later.
NODE = {
    "depth": "long", "conv_id": "long", "parent_conv_id": "long", "n_convs": "long", "n_children": "long", "n_leaves": "long",
    "saved_tokens": "long", "ends_sha256": "string", "open": "boolean", "named": "boolean", "k0": "long", "k1": "long",
    "q0": "long", "q1": "long",
}
NODE_DDL = ", ".join(f"{n} {t}" for n, t in NODE.items())
NODE_SCHEMA = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[t]) for n, t in NODE.items()])
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0, by turn, null first), digest (16 bytes of role and text), chars. Rows without conv_id are left out.

    Turns with one number come in the order of their digests. Places are running counts over ranges, so a conversation with very
    many turns is cut anywhere.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"),
        F.length(text).cast("long").alias("chars"), F.lit(1).cast("long").alias("one"),
    )
    placed = running_sums(rows, ["conv_id", "turn", "digest"], {"one": "pos"}, ["conv_id"])
    return placed.select("conv_id", "pos", "digest", "chars")


def shared_heads(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, d, digest, chars) with d from 0 of every rebuilt conversation, and (conv_id, n_turns), turnless ones too.

    ``turns`` as of ``turn_rows``, written. The first h turns are those of conversation conv_id - conv_id % 100 (% keeps the sign),
    then come the own turns after the first h; h = crc32 of the decimal id % 6.
    """
    base = F.col("conv_id") - F.col("conv_id") % HUNDRED
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own"))
    head = turns.where((F.col("conv_id") % HUNDRED == 0) & (F.col("pos") < HEADS - 1))
    listed = F.array_sort(F.collect_list(F.struct("pos", "digest", "chars")))  # five at most
    head = head.groupBy(F.col("conv_id").alias("base")).agg(listed.alias("head"))
    convs = own.select("conv_id", "n_own", base.alias("base"), shared_heads(F.col("conv_id")).alias("h")).join(head, "base", "left")
    taken = F.slice(F.coalesce("head", F.array().cast(head.schema["head"].dataType)), F.lit(1), F.col("h").cast("int"))
    convs = convs.select("conv_id", "h", taken.alias("head"), F.greatest(F.col("n_own") - F.col("h"), F.lit(0)).alias("rest"))
    convs = materialize(convs.withColumn("n_head", F.size("head").cast("long")), "conversations")
    begin = convs.select("conv_id", F.explode("head").alias("t"))
    begin = begin.select("conv_id", F.col("t.pos").alias("d"), "t.digest", "t.chars")
    after = turns.join(convs.select("conv_id", "h", "n_head"), "conv_id").where("pos >= h")
    after = after.select("conv_id", (F.col("pos") - F.col("h") + F.col("n_head")).alias("d"), "digest", "chars")
    return begin.unionByName(after), convs.select("conv_id", (F.col("n_head") + F.col("rest")).alias("n_turns"))


def key_of(path: Column, window: Column) -> tuple[Column, Column]:
    """Two numbers of 60 bits for a path of turn digests within a window (see ``path_key``)."""
    text = F.concat(window.cast("string"), F.lit(":"), F.array_join(F.transform(path, lambda t: F.hex(t["digest"])), ""))
    digest = F.md5(text)
    return tuple(F.conv(F.substring(digest, a, 15), 16, 10).cast("long") for a in (1, 16))


def path_key(window: int, p0: int, p1: int, digests: bytes) -> tuple[int, int]:
    """The key of a node: that of the window's begin, changed by the turns since. Equal for equal paths in any shard."""
    digest = hashlib.md5(f"{window}:{digests.hex().upper()}".encode()).hexdigest()
    return p0 ^ int(digest[:15], 16), p1 ^ int(digest[15:30], 16)


def windows(rows: DataFrame, convs: DataFrame, longest: int, window: int) -> DataFrame:
    """Per conversation and window of turns: conv_id, w, p0, p1 (key of all turns before), path, ends here or goes on, c0, c1.

    c0, c1 is the key that the next window begins with. A conversation that fills a window exactly ends there; one without turns
    has an empty path in window 0.
    """
    width = F.lit(window).cast("long")
    item = F.struct("d", "digest", "chars")
    cut = rows.groupBy("conv_id", F.floor(F.col("d") / width).alias("w")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    path = F.transform("items", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars")))
    cut = cut.select("conv_id", "w", path.alias("path"))
    zero = F.lit(0).cast("long")
    empty = F.array().cast(cut.schema["path"].dataType)
    cut = cut.unionByName(convs.where("n_turns = 0").select("conv_id", zero.alias("w"), empty.alias("path")))
    if longest <= window:
        return cut.select("*", zero.alias("p0"), zero.alias("p1"), F.lit(True).alias("ends"), zero.alias("c0"), zero.alias("c1"))
    cut = cut.join(convs, "conv_id")
    last = F.greatest(F.ceil(F.col("n_turns") / width) - 1, F.lit(0))
    cut = materialize(cut.select("conv_id", "w", "path", last.alias("last")), "windows")
    short = cut.where("last = 0").select(
        "conv_id", "w", "path", zero.alias("p0"), zero.alias("p1"), F.lit(True).alias("ends"), zero.alias("c0"), zero.alias("c1")
    )
    h0, h1 = key_of(F.col("path"), F.col("w"))
    before = Window.partitionBy("conv_id").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    long = cut.where("last > 0").withColumns({"h0": h0, "h1": h1})
    long = long.withColumns({f"p{i}": F.coalesce(F.bit_xor(f"h{i}").over(before), zero) for i in (0, 1)})
    goes_on = [F.col(f"p{i}").bitwiseXOR(F.col(f"h{i}")).alias(f"c{i}") for i in (0, 1)]
    long = long.select("conv_id", "w", "path", "p0", "p1", (F.col("w") == F.col("last")).alias("ends"), *goes_on)
    return short.unionByName(long)


def id_list_digests(ends: DataFrame, by: list[str], piece: int = PIECE) -> DataFrame:
    """SHA-256 (hex) of the conv_ids of each group, ascending, decimal, joined by commas. ``ends``: the group's columns, conv_id.

    Ids are sorted over ranges. A group within one range is hashed there; the ids of one that lies across ranges become texts of
    at most about ``piece`` bytes, which are read in order, one at a time, so no task holds the ids of a group.
    """
    spark, order = ends.sparkSession, [*by, "conv_id"]
    names = [*by, "part", "number", "piece", "sha"]
    schema = pa.schema([*[(n, pa.int64()) for n in names[:-2]], ("piece", pa.binary()), ("sha", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups but the first and the last of a range are whole."""
        made: list[tuple] = []
        now, first, part, number, ids, size = None, True, -1, 0, [], 0

        def close(whole: bool) -> None:
            if whole:
                made.append((*now, part, 0, None, hashlib.sha256(",".join(ids).encode()).hexdigest()))
            else:
                made.append((*now, part, number, ",".join(ids).encode(), None))

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(by) + 2)]
            for *key, conv_id, in_part in zip(*columns):
                if key != now:
                    if ids:
                        close(not first and number == 0)
                    first = now is None
                    now, part, number, ids, size = key, in_part, 0, [], 0
                text = str(conv_id)
                ids.append(text)
                size += len(text) + 1
                if size >= piece:
                    close(False)
                    number, ids, size = number + 1, [], 0
            if len(made) >= 4096:
                yield _batch(made, schema)
                made.clear()
        if ids:
            close(False)
        yield _batch(made, schema)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = ends.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("part", F.spark_partition_id().cast("long"))
    ddl = ", ".join([*(f"{b} long" for b in by), "part long, number long, piece binary, sha string"])
    pieces = materialize(ranged.select(*order, "part").mapInArrow(scan, ddl), "id-lists").select(*names)
    whole = pieces.where("sha is not null").select(*by, F.col("sha").alias("ends_sha256"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, now, held = [], None, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(by))]
            for *key, piece in zip(*columns, batch.column(len(by) + 2)):
                if key != now:
                    if now is not None:
                        made.append((*now, held.hexdigest()))
                    now, held = key, hashlib.sha256()
                else:
                    held.update(b",")
                held.update(piece.as_buffer())
        if now is not None:
            made.append((*now, held.hexdigest()))
        yield _batch(made, joined)

    joined = pa.schema([*[(b, pa.int64()) for b in by], ("ends_sha256", pa.string())])
    cut = pieces.where("sha is null").repartition(parts, *by).sortWithinPartitions(*by, "part", "number")
    return whole.unionByName(cut.mapInArrow(join, ", ".join([*(f"{b} long" for b in by), "ends_sha256 string"])))


def _batch(made: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*made)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def distinct_paths(cut: DataFrame) -> DataFrame:
    """One row per window and path: w, p0, p1, path, n (conversations), conv_id (the least), on (some go on), c0, c1, ends_sha256."""
    same = ["w", "p0", "p1", "path"]
    rows = cut.groupBy(*same).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.bool_or(~F.col("ends")).alias("on"),
        F.bool_or("ends").alias("some_end"), F.max(F.when(~F.col("ends"), F.col("c0"))).alias("c0"),
        F.max(F.when(~F.col("ends"), F.col("c1"))).alias("c1"),
    )
    h0, h1 = key_of(F.col("path"), F.col("w"))
    end = [F.col("p0").bitwiseXOR(h0).alias("e0"), F.col("p1").bitwiseXOR(h1).alias("e1")]
    digests = materialize(id_list_digests(cut.where("ends").select(*end, "conv_id"), ["e0", "e1"]), "end-digests")
    rows = rows.select("*", *end).join(digests, ["e0", "e1"], "left")
    return rows.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))).drop("e0", "e1", "some_end")


PATH = ["w", "p0", "p1", "path"]


def shards(rows: DataFrame, size: int) -> DataFrame:
    """Rows in ranges of their paths (column ``shard``), with the last row before and the first row after each range (``ghost``)."""
    parts = count_parts(rows.count(), size)
    ranged = rows.repartitionByRange(parts, *PATH).withColumn("shard", F.spark_partition_id())
    ranged = materialize(ranged.withColumn("ghost", F.lit(False)), "shards")
    ends = ranged.groupBy("shard").agg(F.min(F.struct(*PATH)).alias("first"), F.max(F.struct(*PATH)).alias("last"))
    by_shard = Window.orderBy("shard")  # one row a shard
    ends = ends.select("shard", F.lag("last").over(by_shard).alias("before"), F.lead("first").over(by_shard).alias("after"))
    seen = [ends.select("shard", F.col(c).alias("g")).where("g is not null") for c in ("before", "after")]
    ghosts = seen[0].unionByName(seen[1]).select("shard", *[F.col(f"g.{c}").alias(c) for c in PATH], F.lit(True).alias("ghost"))
    return ranged.unionByName(ghosts, allowMissingColumns=True)


class Shard:
    """The rows of a shard and its neighbours' as a padded matrix of turn ids, sorted; rows [a, b) are its own."""

    def __init__(self, part: pa.Table):
        path = part.column("path").combine_chunks()
        length = path.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        rows, width = len(part), int(length.max(initial=0))
        items = path.flatten()
        row = np.repeat(np.arange(rows), length)
        col = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        ids = np.zeros((rows, width, 2), dtype=np.uint64)  # padded with 0, which no digest is
        digests = b"".join(items.field("digest").to_pylist())
        ids[row, col] = np.frombuffer(digests, dtype=">u8").reshape(-1, 2)
        chars = np.zeros((rows, width), dtype=np.int64)
        chars[row, col] = items.field("chars").to_numpy(zero_copy_only=False)
        group = np.stack([part.column(c).to_numpy() for c in PATH[:3]], axis=1)
        keys = [length]
        for j in range(width - 1, -1, -1):
            keys += [ids[:, j, 1], ids[:, j, 0]]
        order = np.lexsort([*keys, group[:, 2], group[:, 1], group[:, 0]])
        self.part, self.width, self.order = part, width, order
        self.length, self.ids, self.chars, self.group = length[order], ids[order], chars[order], group[order]
        own = np.flatnonzero(~self.column("ghost"))
        self.a, self.b = int(own[0]), int(own[-1]) + 1
        new_group = np.ones(rows, dtype=bool)
        new_group[1:] = (self.group[1:] != self.group[:-1]).any(axis=1)
        change = np.ones((rows, width + 1), dtype=bool)  # column j: the first j turns, or the group, differ from the row before
        change[:, 0] = new_group
        change[1:, 1:] = (self.ids[1:] != self.ids[:-1]).any(axis=2)
        self.change = np.logical_or.accumulate(change, axis=1)

    def column(self, name: str) -> np.ndarray:
        held = self.part.column(name).combine_chunks()
        if held.null_count:
            held = held.fill_null(False if pa.types.is_boolean(held.type) else 0)
        return held.to_numpy(zero_copy_only=False)[self.order]

    def key(self, row: int, j: int) -> tuple[int, int]:
        w, p0, p1 = self.group[row].tolist()
        return path_key(w, p0, p1, self.ids[row, :j].astype(">u8").tobytes()) if j else (p0, p1)


def shard_nodes(part: pa.Table, root: int, window: int, groups_only: bool) -> pa.Table:
    """The nodes of a shard (see ``NODE``). ``root``: the least conv_id of all.

    Column by column, change masks tell where a node begins; sums between these places give what its subtree holds. A node that
    began before the shard, or goes on after it, is open: its part counts what begins here only. The begin of a window is a node
    (depth w * window) too: of window 0 it is the root, of others it is given only, and alone, with ``groups_only``.
    """
    s = Shard(part)
    own, n = slice(s.a, s.b), s.b - s.a
    length, change, chars, group = s.length[own], s.change[own], s.chars[own], s.group[own]
    weight, conv, on = (s.column(c)[own] for c in ("n", "conv_id", "on"))
    x_leaves, x_saved, x_children, c0, c1 = (s.column(c)[own] for c in ("x_leaves", "x_saved", "x_children", "c0", "c1"))
    sha = np.array(s.part.column("ends_sha256").to_pylist(), dtype=object)[s.order][own]
    after = np.ones(s.width + 1, dtype=bool)  # whether the row after the shard leaves the last row's prefix
    if s.b < len(s.length):
        after = s.change[s.b]
    begins = np.zeros((n, s.width + 1), dtype=bool)  # column j: a node of j turns begins
    begins[:, 1:] = change[:, 1:] & (np.arange(s.width)[None] < length[:, None])
    leaves_path = np.append(change[1:, :][np.arange(n - 1), length[:-1]], after[length[-1]])
    leaf = (leaves_path & ~on & (length > 0)) + x_leaves
    new_chars = np.where(begins[:, 1:], chars, 0)
    left = np.cumsum(chars[:, ::-1], axis=1)[:, ::-1] * weight[:, None] - np.cumsum(new_chars[:, ::-1], axis=1)[:, ::-1]
    left = np.concatenate([left, np.zeros((n, 1), dtype=np.int64)], axis=1)  # column j: from turn j on, to the end of the window
    made: list[dict] = []
    above = None
    for j in range(s.width + 1):
        first = np.flatnonzero(change[:, j])
        runs_on = not change[0, j]  # the first segment began in an earlier shard
        if runs_on:
            first = np.append(0, first)
        segment = np.cumsum(change[:, j]) - (0 if runs_on else 1)
        is_open = np.zeros(len(first), dtype=bool)
        is_open[0] |= runs_on
        is_open[-1] |= not after[j]
        begun = np.ones(len(first), dtype=bool)
        begun[0] = not runs_on
        least = np.minimum.reduceat(conv, first)
        kids = begins[:, j + 1] if j < s.width else np.zeros(n, dtype=bool)
        ends_here = length[first] == j
        into = ends_here & on[first]  # goes on in another window
        kids = kids + np.where((length == j) & on, x_children, 0)
        below = left[:, j] if j == 0 else left[:, j - 1]
        node = {
            "depth": group[first, 0] * window + j, "conv_id": least, "n_convs": np.add.reduceat(weight, first),
            "n_children": np.add.reduceat(kids, first), "n_leaves": np.add.reduceat(leaf, first),
            "saved_tokens": np.add.reduceat(below + x_saved, first),
            "ends_sha256": np.where(begun, np.where(ends_here, sha[first], EMPTY), None),
        }
        if j == 0:
            keep = np.full(len(first), True) if groups_only else group[first, 0] == 0
            is_open |= keep
            node["ends_sha256"] = np.where(begun & ends_here, sha[first], None)
        else:
            keep = length[first] >= j
        named = is_open | into
        k0, k1 = np.where(into, c0[first], 0), np.where(into, c1[first], 0)
        for i in np.flatnonzero(is_open & keep & ~into):
            k0[i], k1[i] = s.key(s.a + int(first[i]), j)
        node |= {"open": is_open, "named": named, "k0": k0, "k1": k1}
        if j == 0:
            parent, unknown = least, np.zeros(len(first), dtype=bool)
            q0, q1, no_parent = k0, k1, np.ones(len(first), dtype=bool)
            upper = {"m": np.full(len(first), root), "open": group[first, 0] > 0, "k0": group[first, 1], "k1": group[first, 2]}
        else:
            up = above["segment"][first]
            parent, unknown = above["m"][up], above["open"][up]
            q0, q1, no_parent = above["k0"][up], above["k1"][up], np.zeros(len(first), dtype=bool)
            upper = {"m": least, "open": is_open, "k0": k0, "k1": k1}
        node |= {"parent_conv_id": parent, "parent_null": unknown | no_parent, "q0": q0, "q1": q1, "q_null": ~unknown}
        made.append({name: values[keep] for name, values in node.items()})
        above = upper | {"segment": segment}
        if groups_only:
            break
    whole = {name: np.concatenate([m[name] for m in made]) for name in made[0]}
    masks = {"parent_conv_id": "parent_null", "k0": "named", "k1": "named", "q0": "q_null", "q1": "q_null"}
    columns = []
    for field in NODE_SCHEMA:
        mask = whole[masks[field.name]] if field.name in masks else None
        mask = ~mask if field.name in ("k0", "k1") else mask
        columns.append(pa.array(whole[field.name], field.type, mask=mask))
    return pa.Table.from_arrays(columns, schema=NODE_SCHEMA)


def find_nodes(rows: DataFrame, root: int, window: int, shard: int, groups_only: bool = False) -> DataFrame:
    def nodes(part: pa.Table) -> pa.Table:
        return shard_nodes(part, root, window, groups_only)

    return shards(rows, shard).groupBy("shard").applyInArrow(nodes, NODE_DDL)


def add_parts(parts: DataFrame) -> DataFrame:
    """Whole nodes from the parts that shards have of them."""
    added = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    return parts.groupBy("depth", "k0", "k1").agg(
        F.min("conv_id").alias("conv_id"), F.max("parent_conv_id").alias("parent_conv_id"), *[F.sum(c).alias(c) for c in added],
        F.coalesce(F.max("ends_sha256"), F.lit(EMPTY)).alias("ends_sha256"), F.max("q0").alias("q0"), F.max("q1").alias("q1"),
    )


def named(**names: str) -> list[Column]:
    return [F.col(old).alias(new) for old, new in names.items()]


def below_windows(rows: DataFrame, root: int, longest: int, window: int, shard: int) -> DataFrame:
    """What hangs below each window's begin, all further windows included: c0, c1, x_leaves, x_saved, x_children.

    Begins form a forest. With each round a begin knows what lies below it within twice as many windows, and its ancestor twice as
    far up, so the rounds are the logarithm of the longest conversation's windows.
    """
    later = rows.where("w > 0")
    own = add_parts(find_nodes(later, root, window, shard, groups_only=True))
    own = own.select("k0", "k1", "n_children", "n_leaves", "saved_tokens")
    up = rows.where(F.col("on") & (F.col("w") > 0)).select(*named(c0="k0", c1="k1", p0="u0", p1="u1"))
    now = materialize(own.join(up, ["k0", "k1"], "left"), "window-begins")
    far = 1
    while far * window < longest:
        sums = now.where("u0 is not null").groupBy(F.col("u0").alias("k0"), F.col("u1").alias("k1")).agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved")
        )
        above = now.where("u0 is not null").select(*named(k0="u0", k1="u1", u0="v0", u1="v1"))
        now = now.join(sums, ["k0", "k1"], "left").join(above, ["u0", "u1"], "left")
        zero = F.lit(0)
        now = materialize(now.select(
            "k0", "k1", "n_children", (F.col("n_leaves") + F.coalesce("more_leaves", zero)).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("more_saved", zero)).alias("saved_tokens"), *named(v0="u0", v1="u1"),
        ), "window-begins")
        far *= 2
    return now.select(*named(k0="c0", k1="c1", n_leaves="x_leaves", saved_tokens="x_saved", n_children="x_children"))


def prefix_trie(conversations: DataFrame, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """The prefix trie of rebuilt conversations: one row per distinct sequence of first turns (role, text), the root included.

    ``conversations``: conv_id, turn, role, text. Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. Null role or text is empty; null turns come first; turns with one number come in the order
    of their digests; rows that repeat are turns of their own; rows without conv_id are left out; other columns play no part. An
    empty table has no root and gives no rows. Turns are told apart by 128-bit digests.

    Texts are read once and not moved. A conversation is cut into windows of ``window`` turns, equal windows after equal beginnings
    are counted before they meet, and the distinct ones lie in ranges of about ``shard`` rows, so common first turns, conversations
    or very long ones are spread. Nodes that lie across ranges are added up by key.
    """
    turns = materialize(turn_rows(conversations), "turns")
    rows, convs = rebuilt(turns)
    convs = materialize(convs, "conversation-lengths")
    facts = convs.agg(F.max("n_turns").alias("longest"), F.min("conv_id").alias("root")).first()
    longest, root = facts["longest"] or 0, facts["root"] or 0
    cut = materialize(windows(rows, convs, longest, window), "windows-cut")
    paths = materialize(distinct_paths(cut), "paths")
    zero = F.lit(0).cast("long")
    extra = {c: zero for c in ("x_leaves", "x_saved", "x_children")}
    if longest > window:
        begins = materialize(below_windows(paths.withColumns(extra), root, longest, window, shard), "below-windows")
        paths = paths.join(begins, ["c0", "c1"], "left").withColumns({c: F.coalesce(c, zero) for c in extra})
    else:
        paths = paths.withColumns(extra)
    parts = materialize(find_nodes(paths, root, window, shard), "node-parts")
    known = [*RESULT, "k0", "k1", "q0", "q1"]
    opened = materialize(add_parts(parts.where("open")).select(*known), "open-nodes")
    whole = parts.where("not open").select(*known)
    names = opened.select("k0", "k1", "conv_id").unionByName(whole.where("k0 is not null").select("k0", "k1", "conv_id"))
    names = names.select(F.col("k0").alias("q0"), F.col("k1").alias("q1"), F.col("conv_id").alias("up"))
    every = whole.unionByName(opened)
    every = every.withColumn("n_leaves", F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("n_leaves")))
    asked = every.where("q0 is not null").join(names, ["q0", "q1"]).withColumn("parent_conv_id", F.col("up"))
    return every.where("q0 is null").select(*RESULT).unionByName(asked.select(*RESULT))
