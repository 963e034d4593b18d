"""Quotation linking: nested quote levels, quoted passages joined to the messages they come from, reply order.

Column functions and SQL only. A line's level is the number of ``>`` in front of it. A passage is a run of lines of one
level above 0; an attribution ("On ... wrote:") is a line of lower level right before one. Passages and the lines
of messages are normalised (lower case, letters and digits only, single spaces) and hashed; within a
conversation a quoted line, or a whole passage, comes from the earliest message that has the same in its own
words, if that message is earlier. A passage's origin is the message with most of its characters (ties: the
later one); a message replies to the origin of its passage with the lowest level, then most characters.

Result per message: its own words (level 0, without attributions), parent, root and depth of the reply tree,
and ``reply_order``: sorting by (conv_id, reply_order) gives threads in the order of their first message, in
them generations, in these turns. Messages that quote nothing known are roots.

A null text has no lines; messages with a null conv_id or turn neither quote nor are quoted, and are roots.
Repeated messages (same conv_id, turn, role, text) are returned as often as they occur; of different messages
with one conv_id and turn the one with the smallest text hash is linked. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..skew import join_null_safe
from .common import stored

QUOTE = r"^((?:[ \t]?>)+)[ \t]?"
ATTRIBUTION = r"(?i)(wrote|writes|schrieb|a écrit|escribió)\s*:\s*$"
ROUNDS = 64  # each doubles the length of the paths followed


def normal(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " "))


def parsed(text: Column) -> Column:
    """array<struct<pos,level,body,attribution>> of a text's lines."""
    lines = F.split(F.coalesce(text, F.lit("")), "\r?\n", -1)
    level = F.transform(lines, lambda x: F.length(F.regexp_replace(F.regexp_extract(x, QUOTE, 1), "[^>]", "")))
    return F.transform(F.arrays_zip(lines.alias("x"), level.alias("v")), lambda z, i: F.struct(
        i.alias("pos"), z["v"].alias("level"), F.regexp_replace(z["x"], QUOTE, "").alias("body"),
        (z["x"].rlike(ATTRIBUTION) & (F.coalesce(F.get(level, i + 1), F.lit(0)) > z["v"])).alias("attribution")))


def own_words(lines: Column) -> Column:
    kept = F.filter(lines, lambda x: (x["level"] == 0) & ~x["attribution"])
    return F.trim(F.array_join(F.transform(kept, lambda x: x["body"]), "\n"), F.lit("\n\r\t "))


def messages(conversations: DataFrame) -> DataFrame:
    """Distinct messages with uid, lines parsed where there are quotes, own words, and how often each occurs."""
    quoting = F.coalesce(F.col("text"), F.lit("")).rlike(r"(?m)^[ \t]?>")
    d = conversations.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    d = d.withColumn("uid", F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("conv_id", "turn", "role", "text")])))
    d = d.withColumn("lines", F.when(quoting, parsed(F.col("text"))))
    return d.withColumn("own", F.when(quoting, own_words(F.col("lines"))).otherwise(F.coalesce(F.trim(F.col("text"), F.lit("\n\r\t ")), F.lit(""))))


def links(msgs: DataFrame) -> DataFrame:
    """(uid, passage, level, chars, origin, origin_turn, matched): the origin of every quoted passage that has one."""
    linked = msgs.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    line = linked.where("lines IS NOT NULL").select("conv_id", "turn", "uid", F.inline("lines"))
    # a message's lines are bounded by its text; only messages with quotes get here
    change = F.expr("CASE WHEN level <> coalesce(lag(level) OVER (PARTITION BY uid ORDER BY pos), -1) THEN 1 ELSE 0 END")
    line = line.withColumn("_c", change).withColumn("passage", F.expr("sum(_c) OVER (PARTITION BY uid ORDER BY pos)"))
    line = line.where("level > 0 AND NOT attribution").withColumn("norm", normal(F.col("body"))).where("norm <> ''")
    whole = line.groupBy("conv_id", "turn", "uid", "passage", "level").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "norm"))), lambda x: x["norm"]), " ").alias("norm"), F.count(F.lit(1)).alias("_n"))
    unit = ["conv_id", "turn", "uid", "passage", "level", "norm"]
    units = line.select(*unit).unionByName(whole.where("_n > 1").select(*unit)).withColumn("hash", F.md5("norm"))
    # the first message of a conversation that has a line, or all its words, as its own
    own = linked.select("conv_id", "turn", "uid", F.explode(F.concat(F.split("own", "\r?\n", -1), F.array("own"))).alias("x"))
    own = own.withColumn("x", normal(F.col("x"))).where("x <> ''").withColumn("hash", F.md5("x"))
    first = own.groupBy("conv_id", "hash").agg(F.min(F.struct(F.col("turn").alias("origin_turn"), F.col("uid").alias("origin"))).alias("o")).select("conv_id", "hash", "o.*")
    hit = units.join(first, ["conv_id", "hash"]).where("origin_turn < turn")
    votes = hit.groupBy("uid", "passage", "level", "origin", "origin_turn").agg(F.sum(F.length("norm")).alias("matched"))
    best = votes.groupBy("uid", "passage", "level").agg(F.max(F.struct("matched", "origin_turn", "origin")).alias("b"))
    return best.select("uid", "passage", "level", "b.*")


def parents(found: DataFrame) -> DataFrame:
    """(uid, parent): the message replied to."""
    best = found.groupBy("uid").agg(F.max(F.struct((-F.col("level")).alias("l"), "matched", "origin_turn", F.col("origin").alias("parent"))).alias("b"))
    return best.select("uid", "b.parent")


def trees(parent: DataFrame) -> DataFrame:
    """(uid, root, depth) of the messages that have a parent, by doubling the paths followed."""
    state = stored(parent.select("uid", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "quote-tree")
    for _ in range(ROUNDS):
        up = state.select(F.col("uid").alias("root"), F.col("root").alias("_up"), F.col("depth").alias("_d"))
        on = state.join(up, "root", "left")
        if on.where("_up IS NOT NULL").isEmpty():
            return state
        state = stored(on.select("uid", F.coalesce("_up", "root").alias("root"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth")), "quote-tree")
    raise RuntimeError("reply paths longer than 2^64")


def threads(conversations: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, own_text, n_quoted (passages linked), parent_turn, root_turn, depth, reply_order."""
    msgs = stored(messages(conversations), "quote-messages")
    found = stored(links(msgs), "quote-links")
    parent = parents(found)
    tree = trees(parent).join(parent, "uid")
    at = msgs.select(F.col("uid").alias("_u"), F.col("turn").alias("_t"))
    tree = tree.join(at.select(F.col("_u").alias("parent"), F.col("_t").alias("parent_turn")), "parent").join(at.select(F.col("_u").alias("root"), F.col("_t").alias("root_turn")), "root")
    quoted = found.groupBy("uid").agg(F.count(F.lit(1)).alias("n_quoted"))
    d = join_null_safe(join_null_safe(msgs, tree.select("uid", "parent_turn", "root_turn", "depth"), ["uid"], "left"), quoted, ["uid"], "left")
    root, depth = F.coalesce("root_turn", "turn"), F.coalesce("depth", F.lit(0)).cast("long")
    # 20 digits that sort like the numbers, negative ones included
    pad = lambda c: F.lpad((F.coalesce(c, F.lit(0)).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return d.select("conv_id", "turn", "role", F.col("own").alias("own_text"), F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"), "parent_turn",
                    root.alias("root_turn"), depth.alias("depth"), F.concat_ws("/", pad(root), pad(depth), pad(F.col("turn"))).alias("reply_order"),
                    F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_i")).drop("_i")


# The same for DuckDB.
SQL = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, text, count(*) AS n,
         md5(concat_ws('|', coalesce(CAST(conv_id AS VARCHAR), chr(0)), coalesce(CAST(turn AS VARCHAR), chr(0)), coalesce(role, chr(0)), coalesce(text, chr(0)))) AS uid
  FROM conversations GROUP BY 1, 2, 3, 4),
l0 AS (SELECT conv_id, turn, uid, unnest(string_split_regex(coalesce(text, ''), '\r?\n')) AS x,
              generate_subscripts(string_split_regex(coalesce(text, ''), '\r?\n'), 1) - 1 AS pos FROM m),
l1 AS (SELECT *, length(regexp_replace(regexp_extract(x, '^((?:[ \t]?>)+)[ \t]?', 1), '[^>]', '', 'g')) AS level,
              regexp_replace(x, '^((?:[ \t]?>)+)[ \t]?', '') AS body FROM l0),
l2 AS (SELECT *, regexp_matches(x, '(?i)(wrote|writes|schrieb|a écrit|escribió)\s*:\s*$')
              AND coalesce(lead(level) OVER (PARTITION BY uid ORDER BY pos), 0) > level AS attr,
              CASE WHEN level <> coalesce(lag(level) OVER (PARTITION BY uid ORDER BY pos), -1) THEN 1 ELSE 0 END AS c FROM l1),
l3 AS (SELECT *, sum(c) OVER (PARTITION BY uid ORDER BY pos) AS passage, trim(regexp_replace(lower(body), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM l2),
w AS (SELECT uid, any_value(conv_id) AS conv_id, any_value(turn) AS turn,
             coalesce(trim(string_agg(body, chr(10) ORDER BY pos) FILTER (WHERE level = 0 AND NOT attr), chr(10) || chr(13) || chr(9) || ' '), '') AS own FROM l3 GROUP BY uid),
q AS (SELECT conv_id, turn, uid, passage, level, norm FROM l3 WHERE level > 0 AND NOT attr AND norm <> ''
      UNION ALL
      SELECT conv_id, turn, uid, passage, level, string_agg(norm, ' ' ORDER BY pos) FROM l3 WHERE level > 0 AND NOT attr AND norm <> '' GROUP BY 1, 2, 3, 4, 5 HAVING count(*) > 1),
o0 AS (SELECT conv_id, turn, uid, norm FROM l3 WHERE level = 0 AND NOT attr
       UNION ALL SELECT conv_id, turn, uid, trim(regexp_replace(lower(own), '[^\p{L}\p{N}]+', ' ', 'g')) FROM w),
o AS (SELECT conv_id, norm, min({'t': turn, 'u': uid}) AS o FROM o0 WHERE norm <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
v AS (SELECT q.uid, passage, level, o.o.u AS origin, o.o.t AS origin_turn, sum(length(q.norm)) AS matched
      FROM q JOIN o ON q.conv_id = o.conv_id AND q.norm = o.norm WHERE o.o.t < q.turn GROUP BY 1, 2, 3, 4, 5),
f AS (SELECT uid, passage, level, max({'m': matched, 't': origin_turn, 'u': origin}) AS b FROM v GROUP BY 1, 2, 3),
p AS (SELECT uid, max({'l': -level, 'm': b.m, 't': b.t, 'u': b.u}) AS b, count(*) AS n_quoted FROM f GROUP BY 1),
t AS (SELECT uid, b.u AS node, 1 AS depth FROM p UNION ALL SELECT t.uid, p.b.u, depth + 1 FROM t JOIN p ON p.uid = t.node),
r AS (SELECT uid, max(depth) AS depth, arg_max(node, depth) AS root FROM t GROUP BY 1),
z AS (SELECT m.conv_id, m.turn, m.role, w.own AS own_text, CAST(coalesce(p.n_quoted, 0) AS BIGINT) AS n_quoted, pm.turn AS parent_turn, coalesce(rm.turn, m.turn) AS root_turn,
             CAST(coalesce(r.depth, 0) AS BIGINT) AS depth, m.n
      FROM m JOIN w USING (uid) LEFT JOIN p USING (uid) LEFT JOIN r USING (uid) LEFT JOIN m pm ON pm.uid = p.b.u LEFT JOIN m rm ON rm.uid = r.root)
SELECT conv_id, turn, role, own_text, n_quoted, parent_turn, root_turn, depth,
       lpad(CAST(CAST(coalesce(root_turn, 0) AS HUGEINT) + 9223372036854775808 AS VARCHAR), 20, '0') || '/' || lpad(CAST(CAST(depth AS HUGEINT) + 9223372036854775808 AS VARCHAR), 20, '0') || '/' || lpad(CAST(CAST(coalesce(turn, 0) AS HUGEINT) + 9223372036854775808 AS VARCHAR), 20, '0') AS reply_order
FROM (SELECT *, unnest(range(n)) AS i FROM z)
"""
