"""Conversation structure repair: fault flags by windows, and the cheapest edits by a fold over the sorted turns.

A repaired conversation's role initials are nothing, or an optional s and then one
or more ua.  So a prefix of it is in one of four states: nothing yet, after s, after
u, after a.  ``aggregate()`` carries a struct (cost, script) for each; a row's edits
and the insertions before it are native expressions, and ``least`` chooses by cost,
then by script.  A script has one letter for each edit: D delete, I and J insert a
user's or assistant's turn, K keep, R and S rerole to user or assistant.  At one
place after one prefix I and J (or R and S) cannot both occur, so scripts are ordered
as their audits are, in which J reads I and S reads R.

A conversation of at most ``LONG`` rows is one array.  A longer one is cut into
chunks by its order; each chunk is folded from all four states to a 4 x 4 matrix of
structs, and matrices are multiplied in groups of ``FAN``, level by level, so that no
step handles more than one chunk or ``FAN`` matrices.  Its repaired text stays in
pieces, one for each chunk, whose hash is taken in order as a stream, as SHA-256 must.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstat.sources.scratch import stash

#: Rows of a conversation, or of what shares a chunk, above which it is cut; turns of a chunk; matrices multiplied at once.
LONG, SPAN, FAN = 4096, 256, 64
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: The characters that no word has.
SPACES = " \t\n\x0b\x0c\r"
STATES = ("e", "s", "u", "a")
_STATE = "struct<c:bigint,s:string>"
_ORDER = ["turn", "role", "text", "copy"]


class Repair(NamedTuple):
    """records: a row for each conversation, with its repaired text unless it is long; pieces: those of long ones (conv_id, part, piece), or None."""

    records: DataFrame
    pieces: DataFrame | None


def damage(rows: DataFrame, share: int = 20) -> DataFrame:
    """Rows (conv_id, turn, role, text, copy, lost) with faults by crc32(conv_id:turn) % share; nulls of role and text become one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % share
    role, text = shown("role"), shown("text")
    return rows.select(
        "conv_id", F.col("turn").try_cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"), (kind == 0).alias("lost"),
    )


def undamaged(rows: DataFrame) -> DataFrame:
    """Rows as they are, in the form of ``damage``."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", F.col("turn").try_cast("long").alias("turn"), shown("role"), shown("text"), F.lit(0).alias("copy"), F.lit(False).alias("lost"))


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """a with b's other columns; null keys are equal."""
    names = {k: f"_{k}" for k in keys}
    b = b.withColumnsRenamed(names)
    return a.join(b, reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[n]) for k, n in names.items()]), how).drop(*names.values())


def _struct(states: dict[str, Column]) -> Column:
    return F.struct(*(states[k].alias(k) for k in STATES))


def _add(state: Column, cost: Column, letter: Column) -> Column:
    """The state with one more edit; null where it cannot be reached."""
    return F.when(state.isNotNull(), F.struct((state["c"] + cost).alias("c"), F.concat(state["s"], letter).alias("s")))


def _inserted(v: Column) -> Column:
    """The states after any insertions that can pay."""
    put = lambda x, letter: _add(x, F.lit(INSERT), F.lit(letter))
    u = F.least(v["u"], put(v["e"], "I"), put(v["s"], "I"), put(v["a"], "I"))
    after = F.transform(F.array(u), lambda x: _struct({"e": v["e"], "s": v["s"], "u": x, "a": F.least(v["a"], put(x, "J"))}))
    return F.get(after, F.lit(0))


def _edited(v: Column, x: Column) -> Column:
    """The states after keeping, reroling or deleting one row."""
    gone = {k: _add(v[k], F.lit(DELETE), F.lit("D")) for k in STATES}
    may = x["fault"] < 2
    cost = F.when(x["fault"] == 1, CUT).otherwise(0)

    def become(state: Column, initial: str, letter: str) -> Column:
        own = x["initial"] == initial
        return F.when(may, _add(state, cost + F.when(own, 0).otherwise(REROLE), F.when(own, "K").otherwise(letter)))

    return _struct(
        {
            "e": gone["e"],
            "s": F.least(gone["s"], F.when(may & (x["initial"] == "s"), _add(v["e"], cost, F.lit("K")))),
            "u": F.least(gone["u"], become(F.least(v["e"], v["s"], v["a"]), "u", "R")),
            "a": F.least(gone["a"], become(v["u"], "a", "S")),
        }
    )


def _start(state: str) -> Column:
    none, here = F.lit(None).cast(_STATE), F.struct(F.lit(0).cast("long").alias("c"), F.lit("").alias("s"))
    return _struct({k: here if k == state else none for k in STATES})


def _fold(turns: Column, start: Column) -> Column:
    return F.aggregate(turns, start, lambda v, x: F.get(F.transform(F.array(_inserted(v)), lambda w: _edited(w, x)), F.lit(0)))


def _best(v: Column) -> Column:
    return F.least(v["e"], _inserted(v)["a"])


def _product(matrices: Column, start: Column) -> Column:
    """The states at the end of consecutive chunks, each a struct of the states that it leads to from each state."""

    def step(v: Column, m: Column) -> Column:
        both = lambda i, j: F.when(v[i].isNotNull() & m[i][j].isNotNull(), F.struct((v[i]["c"] + m[i][j]["c"]).alias("c"), F.concat(v[i]["s"], m[i][j]["s"]).alias("s")))
        return _struct({j: F.least(*(both(i, j) for i in STATES)) for j in STATES})

    return F.aggregate(matrices, start, step)


def _flagged(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows in chunks (``by``) with their fault (0 none, 1 truncated, 2 duplicate, 3 blank) and initial; ``seen``: not the first of its role and text in its chunk."""
    bare = F.btrim("text", F.lit(SPACES))
    w = Window.partitionBy(*by, "key", "role", "text").orderBy(F.asc_nulls_first("turn"), "copy")
    # dealt once: windows and groups both find a chunk in one partition
    keyed = rows.repartition(*by).withColumn("key", F.when(~F.col("lost"), F.xxhash64("role", "text")))
    seen = ~F.col("lost") & (F.row_number().over(w) > 1)
    fault = F.when(bare == "", 3).when(F.col("seen"), 2).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 1).otherwise(0)
    # lost rows are in a window of their own, so that they make no duplicate
    return keyed.withColumn("seen", seen).select(*by, *_ORDER, "lost", "seen", fault.alias("fault"), F.substring("role", 1, 1).alias("initial"))


def _chunks(flagged: DataFrame, by: list[str]) -> DataFrame:
    """One row for each chunk: its turns in order and what its counts need."""
    turn = F.struct(*_ORDER, "fault", "initial")
    c = flagged.groupBy(*by).agg(F.sort_array(F.collect_list(F.when(~F.col("lost"), turn))).alias("turns"))
    each = c.withColumn("times", F.array_compact(F.transform("turns", lambda x: x["turn"])))
    initials = F.transform("turns", lambda x: x["initial"])
    faults = lambda k: F.size(F.filter("turns", lambda x: x["fault"] == k)).cast("long")
    pairs = F.zip_with(F.slice("initials", 1, F.size("initials") - 1), F.slice("initials", 2, F.size("initials")), lambda a, b: F.concat(a, b))
    illegal = F.when(F.size("initials") > 1, F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))).otherwise(0)
    return each.withColumn("initials", initials).select(
        *by, "turns", faults(3).alias("blank"), faults(2).alias("duplicate"), faults(1).alias("truncated"), illegal.cast("long").alias("illegal"),
        F.array_min("times").alias("first"), F.array_max("times").alias("last"), F.size(F.array_distinct("times")).cast("long").alias("distinct"),
        F.get("initials", F.lit(0)).alias("opens"), F.when(F.size("initials") > 0, F.element_at("initials", -1)).alias("closes"),
    )


def _gaps(first: Column, last: Column, distinct: Column) -> Column:
    wide = lambda c: c.cast("decimal(25,0)")
    return F.coalesce((wide(last) - wide(first) + 1 - wide(distinct)).try_cast("long"), F.lit(0).cast("long"))


def _rendered(script: Column, turns: Column) -> Column:
    """``role:text`` of each turn that the script leaves, each with a newline."""
    insertions = lambda s: F.replace(F.replace(s, F.lit("I"), F.lit("user:\n")), F.lit("J"), F.lit("assistant:\n"))
    steps = F.regexp_extract_all(script, F.lit("([IJ]*[DKRS])"), 1)

    def turn(step: Column, x: Column) -> Column:
        edit = F.right(step, F.lit(1))
        role = F.when(edit == "R", "user").when(edit == "S", "assistant").otherwise(x["role"])
        kept = F.when(edit == "D", "").otherwise(F.concat(role, F.lit(":"), x["text"], F.lit("\n")))
        return F.concat(insertions(F.translate(step, "DKRS", "")), kept)

    return F.concat(F.array_join(F.zip_with(steps, turns, turn), ""), insertions(F.regexp_extract(script, "([IJ]*)$", 1)))


def _audit(script: Column) -> Column:
    return F.translate(script, "JS", "IR")


def _short(rows: DataFrame) -> DataFrame:
    """Records of conversations that are one chunk each."""
    c = _chunks(_flagged(rows, ["conv_id"]), ["conv_id"]).withColumn("best", _best(_fold(F.col("turns"), _start("e"))))
    text = _rendered(F.col("best.s"), F.col("turns"))
    return c.select("conv_id", _gaps(F.col("first"), F.col("last"), F.col("distinct")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("best.c").alias("cost"), _audit(F.col("best.s")).alias("audit"), F.substring(text, F.lit(1), F.length(text) - 1).alias("repaired"))


def _cut(rows: DataFrame) -> DataFrame:
    """Rows with ``chunk``: a range of ``SPAN`` turns; where it has too many rows one turn; where that has, its rows of one role and beginning of the text."""
    rows = rows.withColumn("span", F.floor(F.col("turn") / SPAN))
    many = lambda keys, n: stash(rows.groupBy(*keys).count().filter(F.col("count") > LONG).select(*keys, F.lit(True).alias(n)), n)
    tagged = _same(_same(rows, many(["conv_id", "span"], "by_turn"), ["conv_id", "span"]), many(["conv_id", "turn"], "by_text"), ["conv_id", "turn"])
    by_turn, by_text = F.col("by_turn").isNotNull(), F.col("by_text").isNotNull()
    chunk = F.struct("span", F.when(by_turn, F.col("turn")).alias("turn"), F.when(by_text, F.col("role")).alias("role"), F.when(by_text, F.substring("text", 1, 8)).alias("start"), by_turn.alias("by_turn"))
    return tagged.select("conv_id", chunk.alias("chunk"), *_ORDER, "lost")


def _long(rows: DataFrame) -> Repair:
    """Records and pieces of conversations that are cut."""
    by = ["conv_id", "chunk"]
    flagged = stash(_flagged(_cut(rows), by), "flagged")
    # of those that are the first in their chunk, the ones that an earlier chunk has
    heads = flagged.filter("not seen and not lost").select("conv_id", "chunk", "role", "text")
    first = heads.groupBy("conv_id", "role", "text").agg(F.min("chunk").alias("_first"))
    again = _same(heads, first, ["conv_id", "role", "text"]).filter("_first < chunk").drop("_first").withColumn("again", F.lit(True))
    fault = F.when(F.col("again").isNotNull() & (F.col("fault") < 2), 2).otherwise(F.col("fault"))
    marked = _same(flagged, stash(again, "again"), ["conv_id", "chunk", "role", "text"]).withColumn("fault", fault).drop("again")
    order = Window.partitionBy("conv_id").orderBy("chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    c = _chunks(marked, by).withColumns(
        {
            "k": F.row_number().over(order) - 1, "n": F.size("turns"), "from": F.coalesce(F.sum(F.size("turns")).over(before), F.lit(0)),
            "joint": F.concat(F.last("closes", ignorenulls=True).over(before), F.col("opens")),
        }
    )
    c = stash(c, "chunks")
    counts = c.groupBy("conv_id").agg(
        *(F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")), (F.sum("illegal") + F.sum((~F.col("joint").isin("su", "ua", "au")).cast("long"))).alias("_illegal"), F.sum("illegal").alias("_inside"),
        # a turn that has chunks of its own is one turn
        F.min("first").alias("first"), F.max("last").alias("last"), (F.coalesce(F.sum(F.when(~F.col("chunk.by_turn"), F.col("distinct"))), F.lit(0)) + F.count_distinct(F.when(F.col("distinct") > 0, F.col("chunk.turn")))).alias("distinct"),
        F.sort_array(F.collect_list(F.struct("k", "from", "n"))).alias("parts"),
    )
    matrix = lambda fold: F.struct(*(fold(_start(s)).alias(s) for s in STATES)).alias("m")
    level = stash(c.select("conv_id", "k", matrix(lambda s: _fold(F.col("turns"), s))), "matrices")
    while level.agg(F.max("k")).first()[0]:
        groups = level.groupBy("conv_id", F.floor(F.col("k") / FAN).alias("k")).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("k").alias("at"), "m"))), lambda x: x["m"]).alias("ms"))
        level = stash(groups.select("conv_id", "k", matrix(lambda s: _product(F.col("ms"), s))), "matrices")
    done = stash(_same(counts, level.select("conv_id", _best(F.col("m.e")).alias("best")), ["conv_id"], "inner"), "best")
    records = done.select(
        "conv_id", _gaps(F.col("first"), F.col("last"), F.col("distinct")).alias("gaps"), "blank", "duplicate", "truncated", F.coalesce("_illegal", "_inside").alias("illegal"),
        F.col("best.c").alias("cost"), _audit(F.col("best.s")).alias("audit"), F.lit(None).cast("string").alias("repaired"),
    )
    steps = done.withColumn("steps", F.regexp_extract_all(F.col("best.s"), F.lit("([IJ]*[DKRS])"), 1)).withColumn("rest", F.regexp_extract("best.s", "([IJ]*)$", 1))
    own = F.transform("parts", lambda p: F.struct(p["k"].alias("k"), F.concat(F.array_join(F.slice("steps", (p["from"] + 1).cast("int"), p["n"]), ""), F.when(p["k"] == F.size("parts") - 1, F.col("rest")).otherwise("")).alias("script")))
    scripts = steps.select("conv_id", F.explode(own).alias("p")).select("conv_id", "p.k", "p.script")
    pieces = _same(scripts, c.select("conv_id", "k", "turns"), ["conv_id", "k"], "inner").select("conv_id", F.col("k").alias("part"), _rendered(F.col("script"), F.col("turns")).alias("piece"))
    return Repair(records, stash(pieces, "pieces"))


def repair(rows: DataFrame, long: int = LONG) -> Repair:
    """Faults, cheapest edits and repaired text of each conversation of rows in the form of ``damage``.

    A conversation's rows are taken by turn (nulls first), then role, text and copy.  A null conv_id is a conversation; a
    turn that is no whole number counts as null.  A conversation whose rows are all lost has zeros, no edits and an empty
    text; an empty table gives an empty one.  An empty role has no legal neighbour and is reroled or deleted.  Texts of any
    length stay whole.  Rows of one conversation that agree in turn, role and the first eight characters of their text are
    held by one task; all others are cut.
    """
    rows = rows.select("conv_id", *_ORDER, "lost")
    longs = stash(rows.groupBy("conv_id").count().filter(F.col("count") > long).select("conv_id", F.lit(True).alias("long")), "long")
    if longs.isEmpty():
        return Repair(_short(rows), None)
    tagged = _same(rows, longs, ["conv_id"])
    cut = _long(tagged.filter("long").drop("long"))
    return Repair(_short(tagged.filter("long is null").drop("long")).unionByName(cut.records), cut.pieces)


def _hashes(pieces: DataFrame) -> DataFrame:
    """SHA-256 of the pieces of each conversation in order, without the last newline."""
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, held = (), None, b""
        out = lambda: pa.RecordBatch.from_arrays([pa.array(now, ids), pa.array([(state.update(held[:-1]), state.hexdigest())[1]])], ["conv_id", "sha"])
        ids = pa.null()
        for b in batches:
            ids = b.schema.field(0).type
            for conv, piece in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                if now != (conv,):
                    if now:
                        yield out()
                    now, state, held = (conv,), hashlib.sha256(), b""
                piece = piece.as_py().encode()
                if piece:
                    state.update(held)
                    held = piece
        if now:
            yield out()

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, f"conv_id {kind}, sha string")


def digests(repaired: Repair) -> DataFrame:
    """The records with the hash of the repaired ``role:text`` lines in place of the text."""
    out = repaired.records.withColumn("repaired_sha256", F.sha2("repaired", 256)).drop("repaired")
    if repaired.pieces is None:
        return out
    return _same(out, _hashes(repaired.pieces), ["conv_id"]).withColumn("repaired_sha256", F.coalesce("repaired_sha256", "sha")).drop("sha")
