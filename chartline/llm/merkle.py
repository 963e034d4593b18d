"""Merkle manifest of a dataset, as a tree of retained SHA-256 midstates.

A leaf is the digest of a row's fields. Leaves of a language ascend by doc_id; every ``FANOUT`` consecutive nodes (the
last run: fewer, even one) become their parent until one remains, the language's subroot; subroots, null first and then
by UTF-8 bytes, make the root alike. Digests are hashed as lowercase hexadecimal text.

A parent keeps a copy of its running hash state before each of its children (``Parent.before``). When a child changes,
the state kept before its slot is resumed with the replacement and the children to its right; what lies to its left is
never hashed again (``Parent.resume``).

The tree is made in chunks of FANOUT^``LEVELS`` nodes that one task builds whole, so a language of any size is many
groups. The chunks' roots are the nodes of the next round (log4096 of the rows; one small driver question a round). On
the way down each chunk's root gets its path to the root (the siblings above it), and a chunk's leaves share its path
and the states kept along it. Texts are hashed in the scan and never shuffled; the languages' ranks come from range
partitions, and one count for each range and language.

Null fields are '-' (a null doc_id is first in its language); equal doc_ids go by their leaf; repeated rows are leaves
of their own, all returned, and get proofs for their own places. An empty table has no root and gives an empty result. Columns other
than the five are not part of a leaf; clashing names are no matter, as only the five are read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stored

FANOUT, LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER = 3  # rows whose crc32 of the decimal doc_id this divides are tampered with


# --- leaves -------------------------------------------------------------------------------------------------------


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(**replaced: Column) -> Column:
    """Digest of a row's fields, some of them replaced."""
    return F.sha2(F.concat(*[_field(replaced.get(c, F.col(c))) for c in FIELDS]), 256)


def _key(lang: Column) -> Column:
    """Orders languages: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("1"), lang.cast("string")), F.lit("0"))


def leaves(docs: DataFrame, *more: Column) -> DataFrame:
    """(key, doc_id, leaf, pos, size, more): every row's leaf, its place among its language's leaves and their number; stored."""
    extra = docs.select(*more).columns if more else []
    rows = docs.select(_key(F.col("lang")).alias("key"), "doc_id", leaf().alias("leaf"), *more)
    return _ranked(rows, [F.col("key"), F.col("doc_id").asc_nulls_first(), F.col("leaf")], ["doc_id", "leaf", *extra])


def _ranked(rows: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """(key, columns, pos, size): places in their keys by the order, from range partitions; stored."""
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    laid = stored(laid, "merkle-laid", "zstd").withColumn("part", F.shiftright("at", 33))
    # one row for each range and key: rows of that key in the ranges before
    ranges = laid.groupBy("key", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    all_ = W.partitionBy("key")
    before = all_.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("key", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(all_).alias("size"))
    at = laid.join(ranges, ["key", "part"]).select("key", *columns, (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "size")
    return stored(at, "merkle-ranked", "zstd")


# --- parents and chunks -------------------------------------------------------------------------------------------


class Parent:
    """A run of children: their digest, and the hash state kept before each of them."""

    __slots__ = ("before", "digest", "rights", "others")

    def __init__(self, children: list[bytes]):
        h, self.before = hashlib.sha256(), []
        for c in children:
            self.before.append(h.copy())
            h.update(c)
        self.digest = h.hexdigest().encode()
        self.rights = [b"".join(children[i + 1:]) for i in range(len(children))]
        self.others = [b"".join(children[:i]) + r for i, r in enumerate(self.rights)]

    def resume(self, slot: int, child: bytes) -> bytes:
        """The digest with another child in a slot: the state kept before it goes on with it and the right siblings."""
        h = self.before[slot].copy()
        h.update(child)
        h.update(self.rights[slot])
        return h.hexdigest().encode()


class Step:
    """A parent on the way up from a chunk's root, of which only the siblings of one slot are known."""

    __slots__ = ("before", "right", "others")

    def __init__(self, left: bytes, right: bytes):
        self.before, self.right, self.others = hashlib.sha256(left), right, left + right

    def resume(self, child: bytes) -> bytes:
        h = self.before.copy()
        h.update(child)
        h.update(self.right)
        return h.hexdigest().encode()


def grown(nodes: pa.Table, levels: int) -> list[list[Parent]]:
    """Parents by level over a chunk's nodes: that many levels, or, where the chunk is all its key has, until one node remains."""
    out: list[list[Parent]] = []
    if not nodes.num_rows:
        return out
    row, alone = [x.encode() for x in nodes.column("leaf").to_pylist()], nodes.column("size")[0].as_py() <= FANOUT**levels
    while len(row) > 1 if alone else len(out) < levels:
        out.append([Parent(row[i:i + FANOUT]) for i in range(0, len(row), FANOUT)])
        row = [p.digest for p in out[-1]]
    return out


def _chunk(levels: int) -> Column:
    return F.floor(F.col("pos") / FANOUT**levels).cast("long").alias("chunk")


def _up(nodes: DataFrame, levels: int) -> DataFrame:
    """(key, leaf, pos, size) of the chunks' roots: what remains of a key that is one chunk, else nodes of the next round."""
    width = FANOUT**levels

    def run(key: tuple, nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        parents, pos, size = grown(nodes, levels), nodes.column("pos")[0].as_py(), nodes.column("size")[0].as_py()
        root = parents[-1][0].digest.decode() if parents else nodes.column("leaf")[0].as_py()
        return pa.table({"key": nodes.column("key")[:1], "leaf": [root], "pos": [pos // width], "size": [-(-size // width)]})

    return nodes.select("key", "leaf", "pos", "size", _chunk(levels)).groupBy("key", "chunk").applyInArrow(run, "key string, leaf string, pos long, size long")


def rounds(nodes: DataFrame, width: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """Nodes (key, leaf, pos, size) of all rounds from the bottom, and (key, leaf) of the one node that remains of each key.
    The roots of one round are the nodes of the next for keys with several chunks."""
    levels, tops = [nodes], []
    while True:
        up = stored(_up(levels[-1], width), "merkle-nodes")
        tops.append(up.where("size = 1").select("key", "leaf"))
        more = up.where("size > 1")
        if more.isEmpty():
            return levels, reduce(DataFrame.unionByName, tops)
        levels.append(more)


_PATH = "key string, chunk long, subroot string, steps array<struct<left:binary,right:binary>>"
_STEPS = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))


def _own_steps(levels: list[list[Parent]], i: int) -> list[dict]:
    """The siblings left and right of a node and its ancestors inside a chunk."""
    out = []
    for parents in levels:
        p, slot = parents[i // FANOUT], i % FANOUT
        out.append({"left": p.others[slot][:slot * 64], "right": p.rights[slot]})
        i //= FANOUT
    return out


def _below(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """Paths of the chunks whose roots are these nodes, given those of the nodes' own chunks."""

    def run(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes, n = nodes.sort_by("pos"), nodes.num_rows
        parents = grown(nodes, levels)
        more = above.column("steps")[0].as_py() if above.num_rows else []
        sub = above.column("subroot")[0].as_py() if above.num_rows else None
        steps = pa.array([_own_steps(parents, i) + more for i in range(n)], _STEPS)
        return pa.table({"key": nodes.column("key"), "chunk": nodes.column("pos"), "subroot": pa.array([sub] * n, pa.string()), "steps": steps})

    of = nodes.select("key", "leaf", "pos", "size", _chunk(levels))
    return of.groupBy("key", "chunk").cogroup(above.groupBy("key", "chunk")).applyInArrow(run, _PATH)


def paths(levels: list[DataFrame], above: DataFrame, width: int = LEVELS) -> DataFrame:
    """(key, chunk, subroot, steps) of the lowest round's chunks: the siblings from a chunk's root up to its key's top, and on by ``above``
    (the same of the tops, chunk 0)."""
    for nodes in reversed(levels[1:]):
        keys = nodes.select("key").distinct()  # keys with one chunk in the round below go straight on to their top
        down = _below(nodes, above.join(keys, "key", "left_semi"), width)
        above = stored(down.unionByName(above.join(keys, "key", "left_anti")), "merkle-paths")
    return above


# --- manifest -----------------------------------------------------------------------------------------------------


class Manifest:
    """A dataset's tree: its leaves with their places, the languages' subroots, the root, and the way up from every chunk."""

    def __init__(self, docs: DataFrame, *more: Column, width: int = LEVELS):
        self.width, self.leaves = width, leaves(docs, *more)
        self.levels, subroots = rounds(self.leaves, width)
        one = subroots.select(F.lit("").alias("key"), F.col("key").alias("lang_key"), "leaf")
        self.subroots = _ranked(one, [F.col("lang_key")], ["lang_key", "leaf"])
        top, root = rounds(self.subroots, width)
        first = root.first()
        self.root: str | None = first["leaf"] if first else None
        # from every subroot to the root, then from every chunk's root to there
        end = docs.sparkSession.createDataFrame([], _PATH)
        of = self.subroots.select(F.col("pos").alias("chunk"), "lang_key", F.col("leaf").alias("_subroot"))
        down = _below(top[0], paths(top, end, width), width).join(of, "chunk")
        down = down.select(F.col("lang_key").alias("key"), F.lit(0).cast("long").alias("chunk"), F.col("_subroot").alias("subroot"), "steps")
        self.paths = paths(self.levels, stored(down, "merkle-top"), width)

    def folded(self, replaced: str | None = None, siblings: bool = False) -> DataFrame:
        """The leaves with subroot, proof_sha256 and folded_root: the root recomputed with the leaf in column ``replaced`` in
        each leaf's place, one at a time; siblings: also the proof itself, level by level, left to right."""
        width = self.width
        rows = self.leaves.select("*", _chunk(width))
        if replaced is None:
            rows, replaced = rows.withColumn("_new", F.col("leaf")), "_new"
        keep = [c for c in rows.columns if c != "chunk"]
        schema = rows.select(*keep).schema
        more = "subroot string, proof_sha256 string, folded_root string" + (", siblings array<string>" if siblings else "")

        def run(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
            nodes = nodes.sort_by("pos")
            levels = grown(nodes, width)
            way = [Step(s["left"], s["right"]) for s in above.column("steps")[0].as_py()] if above.num_rows else []
            shared = b"".join(s.others for s in way)
            proof, root, sib = [], [], []
            for i, h in enumerate(x.encode() for x in nodes.column(replaced).to_pylist()):
                parts = []
                for parents in levels:
                    p, slot = parents[i // FANOUT], i % FANOUT
                    parts.append(p.others[slot])
                    h = p.resume(slot, h)
                    i //= FANOUT
                for s in way:
                    h = s.resume(h)
                every = b"".join(parts) + shared
                proof.append(hashlib.sha256(every).hexdigest())
                root.append(h.decode())
                if siblings:
                    sib.append([every[k:k + 64].decode() for k in range(0, len(every), 64)])
            sub = above.column("subroot")[0].as_py() if above.num_rows else None
            out = {c: nodes.column(c) for c in keep} | {"subroot": pa.array([sub] * len(root), pa.string()), "proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(root, pa.string())}
            return pa.table(out | ({"siblings": pa.array(sib, pa.list_(pa.string()))} if siblings else {}))

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        return rows.groupBy("key", "chunk").cogroup(self.paths.groupBy("key", "chunk")).applyInArrow(run, f"{fields}, {more}")


def check(root: str | None, docs: DataFrame) -> bool:
    """Whether a dataset has the root of an earlier manifest."""
    return Manifest(docs).root == root


def changed(manifest: Manifest, docs: DataFrame) -> DataFrame:
    """(key, doc_id): leaves of a manifest that a later state of the dataset doesn't have, and new ones (missing: false)."""
    now = docs.select(_key(F.col("lang")).alias("key"), "doc_id", leaf().alias("leaf"), F.lit(1).alias("side"))
    then = manifest.leaves.select("key", "doc_id", "leaf", F.lit(-1).alias("side"))
    by = now.unionByName(then).groupBy("key", "doc_id", "leaf").agg(F.sum("side").alias("d")).where("d <> 0")
    return by.select("key", "doc_id", (F.col("d") < 0).alias("missing"))


def _tampered() -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0
    return F.when(hit, leaf(text=F.translate("text", upper, upper.lower()))).otherwise(leaf()).alias("_tampered")


def report(docs: DataFrame) -> DataFrame:
    """op11: each row's leaf, subroot, root and proof, and the root folded from the tampered row."""
    m = Manifest(docs.select(*FIELDS), _tampered())
    root = F.lit(m.root).cast("string")
    return m.folded("_tampered").select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


_FIELD_SQL = " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in FIELDS)
_LOWERED = _FIELD_SQL.replace("text::VARCHAR", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
_CRC = """list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda r, c:
  list_reduce(list_prepend(xor(r, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""


def _tree_sql(name: str, source: str) -> str:
    """Nodes (k, lvl, pos, h, m) by level; m: the last place of the key's level."""
    return f"""{name}(k, lvl, pos, h, m) AS (
  SELECT k, 0, pos, h, max(pos) OVER (PARTITION BY k) FROM {source}
  UNION ALL
  SELECT k, lvl + 1, pos // {FANOUT}, sha256(string_agg(h, '' ORDER BY pos)), any_value(m) // {FANOUT} FROM {name} WHERE m > 0 GROUP BY k, lvl, pos // {FANOUT})"""


SQL = f"""WITH RECURSIVE base AS (
  SELECT row_number() OVER (ORDER BY doc_id, text) AS row_id, doc_id, coalesce('1' || lang, '0') AS k, sha256({_FIELD_SQL}) AS leaf,
    CASE WHEN xor({_CRC}, 4294967295) % {TAMPER} = 0 THEN sha256({_LOWERED}) ELSE sha256({_FIELD_SQL}) END AS fresh FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM base),
source AS (SELECT k, pos, leaf AS h FROM ranked),
{_tree_sql("tree", "source")},
sub AS (SELECT k, h, row_number() OVER (ORDER BY encode(k)) - 1 AS pos FROM tree WHERE m = 0),
sub_source AS (SELECT '' AS k, pos, h FROM sub),
{_tree_sql("top", "sub_source")},
high AS (SELECT k, max(lvl) AS height FROM tree GROUP BY k),
-- one sequence of levels for each row: those of its language, then those of the subroots
place AS (
  SELECT r.row_id, t.lvl, r.pos // ({FANOUT} ** t.lvl)::BIGINT AS pos, r.k, false AS upper FROM ranked r JOIN (SELECT DISTINCT k, lvl FROM tree WHERE m > 0) t ON t.k = r.k
  UNION ALL
  SELECT r.row_id, h.height + t.lvl, s.pos // ({FANOUT} ** t.lvl)::BIGINT, '', true FROM ranked r JOIN high h ON h.k = r.k JOIN sub s ON s.k = r.k JOIN (SELECT DISTINCT lvl FROM top WHERE m > 0) t ON true),
nodes AS (SELECT k, lvl, pos, h, false AS upper FROM tree UNION ALL SELECT k, lvl, pos, h, true FROM top),
sibling AS (
  SELECT p.row_id, p.lvl, n.pos AS at, n.pos < p.pos AS before, n.h FROM place p JOIN ranked r USING (row_id) JOIN high g ON g.k = r.k
  JOIN nodes n ON n.k = p.k AND n.upper = p.upper AND n.lvl = p.lvl - CASE WHEN p.upper THEN g.height ELSE 0 END AND n.pos // {FANOUT} = p.pos // {FANOUT} AND n.pos <> p.pos),
sides AS (SELECT p.row_id, p.lvl, coalesce(string_agg(s.h, '' ORDER BY s.at) FILTER (WHERE s.before), '') AS l, coalesce(string_agg(s.h, '' ORDER BY s.at) FILTER (WHERE NOT s.before), '') AS r
  FROM place p LEFT JOIN sibling s ON s.row_id = p.row_id AND s.lvl = p.lvl GROUP BY p.row_id, p.lvl),
fold(row_id, lvl, h) AS (
  SELECT row_id, 0, fresh FROM ranked
  UNION ALL
  SELECT f.row_id, f.lvl + 1, sha256(s.l || f.h || s.r) FROM fold f JOIN sides s ON s.row_id = f.row_id AND s.lvl = f.lvl),
proof AS (SELECT row_id, sha256(string_agg(l || r, '' ORDER BY lvl)) AS p FROM sides GROUP BY row_id),
ended AS (SELECT row_id, max_by(h, lvl) AS h FROM fold GROUP BY row_id)
SELECT r.doc_id, r.leaf, s.h AS subroot, t.h AS root, coalesce(p.p, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = t.h AS verified
FROM ranked r JOIN sub s ON s.k = r.k JOIN (SELECT h FROM top WHERE m = 0) t ON true JOIN ended e USING (row_id) LEFT JOIN proof p USING (row_id)"""
