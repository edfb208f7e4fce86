"""Rebuilding conversations from message rows.

A chat comes as fragments: exports of a stretch of it, in order, that overlap where the stretch goes on in
another export. They are put together as a genome is from reads: a fragment is known by the hashes of its
messages; where the last messages of one are the first of another there is an edge of the overlap graph;
fragments that lie within another are left out, edges that follow from two others are left out too, and of
what remains only edges that are alone on both their ends are merged. A chat is whole if its fragments are
one path; its turns are in the order of that path.

The table of messages holds no exports, so they are made from it: runs in which a reply follows each turn,
in fragments of bounded length that overlap as long as the run goes on. Where a reply is missing, a role is
unknown or somebody speaks twice, nothing overlaps, and the chat falls into several paths: it has a gap.

A chat that holds a large share of all messages is cut into spans of time first, which overlap in seams, so
that no task orders all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.skew import heavy_keys
from tessera.session import Workspace
from tessera.sources.tables import current_rows, ref_key

SIZE = 64  #: Messages of a fragment, besides its overlap.
STRETCH = 65_536  #: Places of a path that one task looks at in order.
OVERLAP = 2  #: Messages that a fragment shares with the next.
PIECES = 64  #: Spans of time, of about as many messages each, into which a chat with very many messages is cut.

# The spellings of roles, after lower-casing and trimming.
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "system": "system", "tool": "tool"}

#: What can't be seen: white space, controls, format characters, and fillers that show nothing.
_UNSEEN = r"[\s\p{Z}\p{Cc}\p{Cf}͏ᅟᅠ឴឵᠋-᠏ㅤﾠ︀-️]+"


def role_of(col: Column) -> Column:
    """The folded role; null if it is none of the known."""
    bare = ref_key(col)
    out = F.lit(None).cast("string")
    for kind in dict.fromkeys(ROLES.values()):
        out = F.when(bare.isin([k for k, v in ROLES.items() if v == kind]), F.lit(kind)).otherwise(out)
    return out


def visible(col: Column) -> Column:
    return F.coalesce(F.regexp_replace(col, _UNSEEN, "") != "", F.lit(False))


def turns_of(messages: DataFrame, content: bool) -> DataFrame:
    """Current messages, one row each: chat_id, at, role, live (not deleted and visible), key, and content if asked for.

    Without content the texts don't go through the shuffle.
    """
    cols = ["id", ref_key("chat_id").alias("chat_id"), role_of(F.col("role")).alias("role"), F.col("created_at").alias("at"), "updated_at", (F.col("deleted_at").isNull() & visible(F.col("content"))).alias("live")]
    cur = current_rows(messages.select(*cols, *([F.col("content")] if content else [])))
    return cur.where("chat_id is not null").withColumn("key", F.xxhash64("id", "at", "role")).drop("updated_at")


def pieces(ws: Workspace, live: DataFrame, floor: int | None = None) -> tuple[DataFrame, bool]:
    """live with a number for each span of time of a chat with very many messages, 0 for all others; and whether there are such chats."""
    rows = live.count()
    heavy = heavy_keys(live, ["chat_id"], rows) if floor is None else heavy_keys(live, ["chat_id"], rows, 0.0, floor)
    if heavy is None or heavy.isEmpty():
        return live.withColumn("piece", F.lit(0)), False
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    # At most 1024 chats are heavy, with PIECES numbers each.
    cuts = live.join(F.broadcast(heavy), "chat_id").groupBy("chat_id").agg(F.percentile_approx(micros, [i / PIECES for i in range(1, PIECES)], 2000).alias("cuts"))
    cuts = ws.table(cuts, "cuts")
    met = live.join(F.broadcast(cuts), "chat_id", "left")
    return met.withColumn("piece", F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.size(F.filter("cuts", lambda c: c < micros)))).drop("cuts"), True


def exports(ws: Workspace, turns: DataFrame, size: int = SIZE, overlap: int = OVERLAP, floor: int | None = None) -> DataFrame:
    """(chat_id, export, pos, key, role, at, id): the live messages as overlapping fragments, a row for each message of each."""
    live, cut = pieces(ws, turns.where("live").select("chat_id", "at", "id", "key", "role"), floor)
    w = Window.partitionBy("chat_id", "piece").orderBy("at", "id")
    said = F.when(F.col("role").isin("user", "assistant"), F.col("role"))
    before = F.last(said, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    odd = F.col("role").isNull()
    breaks = odd | F.coalesce(F.lag(odd).over(w), F.lit(False)) | F.coalesce(said == before, F.lit(False))
    runs = live.withColumn("rn", F.row_number().over(w)).withColumn("breaks", breaks).withColumn("run", F.sum(F.col("breaks").cast("int")).over(w))
    runs = runs.withColumn("i", F.col("rn") - F.max(F.when(F.col("breaks") | (F.col("rn") == 1), F.col("rn"))).over(w))
    runs = ws.table(runs.drop("breaks"), "runs") if cut else runs
    k = F.floor(F.col("i") / size)
    both = F.when((k > 0) & (F.col("i") % size < overlap), F.array(k - 1, k)).otherwise(F.array(k))
    name = F.concat_ws("/", F.lpad(F.col("piece").cast("string"), 4, "0"), "run", "k")
    rows = runs.withColumn("k", F.explode(both)).select("chat_id", name.alias("export"), (F.col("i") - F.col("k") * size).cast("int").alias("pos"), "key", "role", "at", "id")
    return rows.unionByName(_seams(runs, overlap)) if cut else rows


def _seams(runs: DataFrame, overlap: int) -> DataFrame:
    """Fragments of the last messages of a piece and the first of the chat's next, if somebody else goes on there."""
    several = runs.where("piece > 0").select("chat_id").distinct()
    r = runs.join(several, "chat_id", "left_semi")
    w = Window.partitionBy("chat_id", "piece").orderBy(F.col("rn").desc())
    r = r.withColumn("back", F.row_number().over(w)).withColumn("end", F.max("run").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    said = F.col("role").isin("user", "assistant")
    message = F.struct("rn", "key", "role", "at", "id")
    ends = r.groupBy("chat_id", "piece").agg(
        F.array_sort(F.collect_list(F.when((F.col("run") == 0) & (F.col("rn") <= overlap), message))).alias("first"),
        F.array_sort(F.collect_list(F.when((F.col("run") == F.col("end")) & (F.col("back") <= overlap), message))).alias("last"),
        F.min_by("role", F.when(said, F.col("rn"))).alias("opens"), F.max_by("role", F.when(said, F.col("rn"))).alias("closes"),
    )
    order = Window.partitionBy("chat_id").orderBy("piece")
    ends = ends.withColumn("before", F.last("closes", ignorenulls=True).over(order)).withColumn("next", F.lead("first").over(order)).withColumn("opens", F.lead("opens").over(order))
    goes_on = F.col("next").isNotNull() & F.coalesce(F.col("opens") != F.col("before"), F.lit(True))
    return ends.where(goes_on).select("chat_id", F.concat(F.lit("seam/"), F.col("piece").cast("string")).alias("export"), F.posexplode(F.concat("last", "next")).alias("pos", "m")).select("chat_id", "export", "pos", "m.key", "m.role", "m.at", "m.id")


def overlap_edges(fragments: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """From (chat_id, export, pos, key): (chat_id, export, n) of the fragments that aren't within another, and the
    edges (chat_id, a, b, shift) to be merged; b begins ``shift`` messages behind a.

    A fragment's messages are one array, so their number must be bounded by the exporter. Only fragments that
    hold another's first message are compared with it.
    """
    f = fragments.groupBy("chat_id", "export").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda x: x["key"]).alias("seq"))
    f = ws.table(f.withColumn("n", F.size("seq")), "fragments")
    places = f.select("chat_id", F.col("export").alias("a"), F.posexplode("seq").alias("p", "h"))
    heads = f.select("chat_id", F.col("export").alias("b"), F.col("seq")[0].alias("h"))
    met = places.join(heads, ["chat_id", "h"]).where("a != b")
    met = met.join(f.select("chat_id", F.col("export").alias("a"), F.col("seq").alias("sa"), F.col("n").alias("na")), ["chat_id", "a"]).join(f.select("chat_id", F.col("export").alias("b"), F.col("seq").alias("sb"), F.col("n").alias("nb")), ["chat_id", "b"])
    both = F.least(F.col("na") - F.col("p"), F.col("nb"))
    met = met.where(F.slice("sa", F.col("p") + 1, both) == F.slice("sb", F.lit(1), both))
    met = ws.table(met.select("chat_id", "a", "b", "p", (F.col("na") - F.col("p") >= F.col("nb")).alias("within"), ((F.col("na") == F.col("nb")) & (F.col("p") == 0)).alias("equal")), "met")
    within = met.where("within and (not equal or a < b)").select("chat_id", F.col("b").alias("export")).distinct()
    kept = ws.table(f.select("chat_id", "export", "n").join(within, ["chat_id", "export"], "left_anti"), "kept")
    inside = lambda c: kept.select("chat_id", F.col("export").alias(c))
    edges = met.where("not within and p > 0").groupBy("chat_id", "a", "b").agg(F.min("p").alias("shift")).join(inside("a"), ["chat_id", "a"], "left_semi").join(inside("b"), ["chat_id", "b"], "left_semi")
    edges = ws.table(edges, "edges")
    # An edge that two others lead along says nothing new.
    long = edges.select("chat_id", "a", F.col("b").alias("m"), F.col("shift").alias("s1")).join(edges.select("chat_id", F.col("a").alias("m"), "b", F.col("shift").alias("s2")), ["chat_id", "m"])
    edges = edges.join(long.select("chat_id", "a", "b", (F.col("s1") + F.col("s2")).alias("shift")).distinct(), ["chat_id", "a", "b", "shift"], "left_anti")
    out, into = Window.partitionBy("chat_id", "a"), Window.partitionBy("chat_id", "b")
    edges = edges.withColumn("o", F.count("*").over(out)).withColumn("i", F.count("*").over(into)).where("o = 1 and i = 1")
    return kept, ws.table(edges.select("chat_id", "a", "b", "shift"), "merged")


def assemble(fragments: DataFrame, ws: Workspace) -> DataFrame:
    """(chat_id, export, head, offset): each fragment's path, named by its first fragment, and where it begins in it.

    Fragments within another have no row; those on a circle have a null head. Paths are followed by pointer
    jumping: a path of n fragments takes about log n rounds.
    """
    kept, edges = overlap_edges(fragments, ws)
    state = kept.join(edges.select("chat_id", F.col("b").alias("export"), F.col("a").alias("to"), "shift"), ["chat_id", "export"], "left")
    state = ws.table(state.select("chat_id", "export", F.coalesce("to", "export").alias("to"), F.coalesce("shift", F.lit(0)).cast("long").alias("offset"), F.col("to").isNull().alias("done")), "paths")
    open_, before = state.where("not done").count(), -1
    # In each round some path ends as long as any is left: each has a first fragment, which is done.
    while open_ and open_ != before:
        ahead = state.select("chat_id", F.col("export").alias("to"), F.col("to").alias("to2"), F.col("offset").alias("o2"), F.col("done").alias("done2"))
        moved = state.where("not done").join(ahead, ["chat_id", "to"]).select("chat_id", "export", F.col("to2").alias("to"), (F.col("offset") + F.col("o2")).alias("offset"), F.col("done2").alias("done"))
        after = ws.table(state.where("done").unionByName(moved), "paths")
        ws.drop(state)
        state, before = after, open_
        open_ = state.where("not done").count()
    return state.select("chat_id", "export", F.when(F.col("done"), F.col("to")).alias("head"), "offset")


def placed_messages(fragments: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(chat_id, place, key, role, at, id) of every message of the fragments that are in a path, in the order of the
    path (overlaps repeat); and (chat_id, kept): whether all fragments of a chat are one path and its turns a
    clean conversation.

    Turns of user and assistant alternate from the first, a user's, to the last, an assistant's; system and tool
    turns are skipped; any other role spoils the chat. A chat of one fragment needs no graph.
    """
    several = fragments.groupBy("chat_id").agg((F.min("export") != F.max("export")).alias("several"))
    marked = ws.table(fragments.join(several, "chat_id"), "exports")
    many = marked.where("several").drop("several")
    paths = ws.table(assemble(many, ws), "placed")
    one = marked.where("not several").drop("several").withColumn("place", F.col("pos").cast("long"))
    put = many.join(paths.where("head is not null"), ["chat_id", "export"]).withColumn("place", F.col("offset") + F.col("pos")).drop("head", "offset")
    rows = one.unionByName(put)
    broken = paths.groupBy("chat_id").agg(F.count_distinct("head").alias("paths"), F.count_if(F.col("head").isNull()).alias("circular")).where("paths != 1 or circular > 0").select("chat_id")
    # One message at each place; overlaps fall together here. Alternation is looked at in blocks of places, so
    # that no task orders a whole chat, and then between the blocks.
    said = F.col("role").isin("user", "assistant")
    spots = rows.where(said).groupBy("chat_id", "place").agg(F.first("role").alias("role")).withColumn("block", F.floor(F.col("place") / STRETCH))
    w = Window.partitionBy("chat_id", "block").orderBy("place")
    spots = spots.withColumn("same", F.coalesce(F.lag("role").over(w) == F.col("role"), F.lit(False)))
    blocks = spots.groupBy("chat_id", "block").agg(F.bool_or("same").alias("same"), F.min_by("role", "place").alias("opens"), F.max_by("role", "place").alias("closes"))
    across = F.coalesce(F.lag("closes").over(Window.partitionBy("chat_id").orderBy("block")) == F.col("opens"), F.lit(False))
    ends = blocks.withColumn("same", F.col("same") | across).groupBy("chat_id").agg(F.bool_or("same").alias("same"), F.min_by("opens", "block").alias("opens"), F.max_by("closes", "block").alias("closes"))
    verdict = ends.where("not same and opens = 'user' and closes = 'assistant'").select("chat_id")
    odd = rows.where("role is null").select("chat_id").distinct()
    return rows, verdict.join(broken, "chat_id", "left_anti").join(odd, "chat_id", "left_anti")


def _live(messages: DataFrame, content: bool) -> DataFrame:
    return turns_of(messages, content).withColumn("at", F.coalesce("at", F.lit("1970-01-01").cast("timestamp_ntz")))


def broken_chats(messages: DataFrame, size: int = SIZE, overlap: int = OVERLAP, floor: int | None = None) -> DataFrame:
    """(chat_id): chats to be dropped, those without any live message too.

    Null or blank chat ids are no chats. Of repeated and earlier states of a message the current one counts; a
    null role is an unknown role; messages of null created_at count as before all others.
    """
    ws = Workspace(messages.sparkSession)
    turns = ws.table(_live(messages, content=False), "turns")
    _, kept = placed_messages(exports(ws, turns, size, overlap, floor), ws)
    return turns.select("chat_id").distinct().join(kept, "chat_id", "left_anti")


def conversations(messages: DataFrame, size: int = SIZE, overlap: int = OVERLAP, floor: int | None = None) -> DataFrame:
    """(chat_id, turn, role, content, created_at, message_id): the turns of the kept chats, numbered from 1.

    One row for each turn, so that a chat of any length is never one value; the numbers are places in the
    merged path.
    """
    ws = Workspace(messages.sparkSession)
    turns = ws.table(_live(messages, content=True), "turns")
    rows, kept = placed_messages(exports(ws, turns, size, overlap, floor), ws)
    numbers = rows.join(kept, "chat_id", "left_semi").select("chat_id", (F.col("place") + 1).alias("turn"), "role", F.col("at").alias("created_at"), "id").distinct()
    return numbers.join(turns.select("id", "content"), "id").select("chat_id", "turn", "role", "content", "created_at", F.col("id").alias("message_id"))


def conversations_of_fragments(fragments: DataFrame) -> DataFrame:
    """(chat_id, turn, role, message_id): conversations put together from given exports alone.

    fragments: chat_id, export, pos, message_id, role, one row for each message of each export; the times of
    messages aren't known. Chats whose fragments don't join to one path, as one is missing or several go on
    from one place, are left out, and those whose turns don't alternate. Rows of null chat_id, export, pos or
    message_id are left out; repeated rows count once.
    """
    ws = Workspace(fragments.sparkSession)
    rows = fragments.where("chat_id is not null and export is not null and pos is not null and message_id is not null")
    rows = rows.select("chat_id", F.col("export").cast("string").alias("export"), F.col("pos").cast("int").alias("pos"), F.xxhash64("message_id").alias("key"), role_of(F.col("role")).alias("role"), F.lit(None).cast("timestamp_ntz").alias("at"), F.col("message_id").alias("id")).distinct()
    placed, kept = placed_messages(rows, ws)
    return placed.join(kept, "chat_id", "left_semi").select("chat_id", (F.col("place") + 1).alias("turn"), "role", F.col("id").alias("message_id")).distinct()
