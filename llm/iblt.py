"""Document fingerprints as invertible Bloom lookup tables over paragraph digests, native.

A text's paragraphs (lines, cut into pieces of at most ``PIECE`` characters) are hashed to 64-bit
digests. Each distinct digest goes into one cell of each of three sub-tables; a cell holds how many
digests it got, their exclusive or, and the exclusive or of their check hashes. Subtracting two
tables cell by cell leaves the digests in which the texts differ, and peeling recovers them: a
cell with one digest (count of one, check hash right) gives it away and is taken out of its
other cells, until nothing is left. Where peeling gets stuck, the difference was too large; that pair is
tried again in a larger table: its digests are dealt out over as many tables as they need, and any
of these that still gets stuck is split once more with other hashes, until none is.

All of it is built-in functions on columns: tables are arrays of structs in their row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_key

PIECE = 256
SUBTABLES = 3
SLOTS = 12
ROUNDS = 10
PER_TABLE = 12
_CELL = "struct<n:int,key:bigint,chk:bigint>"
_FOUND = "array<struct<n:int,key:bigint>>"
_PLACED = "array<struct<n:int,key:bigint,chk:bigint,s0:int,s1:int,s2:int>>"


def digests(text: Column) -> Column:
    """Distinct paragraph digests of a text; blank paragraphs count like others, no paragraph none."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^\n]{{1,{PIECE}}}"), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(5))


def _slot(key: Column, sub: Column, salt: int) -> Column:
    h = F.xxhash64(key, F.lit(salt))
    return F.pmod(F.when(sub == 0, h).when(sub == 1, F.shiftright(h, 20)).otherwise(F.shiftright(h, 40)), F.lit(SLOTS))


def _cell(n: Column, key: Column, chk: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), key.alias("key"), chk.alias("chk"))


def _placed(n: Column, key: Column, salt: int) -> Column:
    """A digest with its check hash and its cells (numbered over all sub-tables)."""
    spots = [(_slot(key, F.lit(s), salt) + s * SLOTS).cast("int").alias(f"s{s}") for s in range(SUBTABLES)]
    return F.struct(n.cast("int").alias("n"), key.alias("key"), _check(key).alias("chk"), *spots)


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cells(keys: Column, salt: int = 0) -> Column:
    """The table of a set of digests."""
    empty = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))

    def fill(placed: Column, sub: int) -> Column:
        def one(slot: Column) -> Column:
            own = F.filter(placed, lambda p: p[f"s{sub}"] == slot)
            return F.aggregate(own, empty, lambda c, p: _cell(c["n"] + 1, c["key"].bitwiseXOR(p["key"]), c["chk"].bitwiseXOR(p["chk"])))

        return F.transform(F.sequence(F.lit(sub * SLOTS), F.lit((sub + 1) * SLOTS - 1)), one)

    spread = F.transform(keys, lambda k: _placed(F.lit(1), k, salt))
    return _with(spread, lambda placed: F.concat(*[fill(placed, s) for s in range(SUBTABLES)]))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["key"].bitwiseXOR(y["key"]), x["chk"].bitwiseXOR(y["chk"])))


def peel(table: Column, salt: int = 0) -> Column:
    """``cells`` left and ``found`` digests (``n``: 1 on the left side only, -1 on the right)."""

    def take(state: Column) -> Column:
        pure = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["chk"] == _check(c["key"])))
        new = F.array_distinct(F.transform(pure, lambda c: F.struct(c["n"].alias("n"), c["key"].alias("key"))))
        placed = F.transform(new, lambda p: _placed(p["n"], p["key"], salt))
        return F.struct(state["cells"].alias("cells"), state["found"].alias("found"), placed.alias("new"))

    def drop(state: Column) -> Column:
        def less(c: Column, j: Column) -> Column:
            here = F.filter(state["new"], lambda p: (p["s0"] == j) | (p["s1"] == j) | (p["s2"] == j))
            return F.aggregate(here, c, lambda x, p: _cell(x["n"] - p["n"], x["key"].bitwiseXOR(p["key"]), x["chk"].bitwiseXOR(p["chk"])))

        taken = F.transform(state["new"], lambda p: F.struct(p["n"].alias("n"), p["key"].alias("key")))
        return F.struct(
            F.transform(state["cells"], less).alias("cells"), F.concat(state["found"], taken).alias("found"),
            F.array().cast(_PLACED).alias("new"),
        )

    def step(state: Column, i: Column) -> Column:
        # two turns of the fold make a round: the first names the pure cells, the second takes them out
        nothing = F.size(state["new"]) == 0
        return F.when(i % 2 == 0, take(state)).when(nothing, state).otherwise(drop(state))

    start = F.struct(table.alias("cells"), F.array().cast(_FOUND).alias("found"), F.array().cast(_PLACED).alias("new"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS - 1)), start, step)


def emptied(state: Column) -> Column:
    return F.forall(state["cells"], lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["chk"] == 0))


def as_text(table: Column) -> Column:
    """The table as text: count, digests and check hashes of each cell."""
    return F.array_join(F.transform(table, lambda c: F.concat_ws(":", c["n"].cast("string"), F.hex(c["key"]), F.hex(c["chk"]))), ",")


def _signed(keys: Column, side: int) -> Column:
    return F.transform(keys, lambda k: F.struct(k.alias("k"), F.lit(side).alias("side")))


def differences(pairs: DataFrame) -> DataFrame:
    """``row, kind, differing`` of ``row, kind, a, b, fa, fb``: how many digests stand in one of the
    sets ``a`` and ``b`` only, recovered from their tables ``fa`` and ``fb``, or larger ones."""
    tried = stored(
        pairs.withColumn("left", peel(minus(F.col("fa"), F.col("fb")))).select(
            "row", "kind", emptied(F.col("left")).alias("ok"), F.size("left.found").alias("d"), F.when(~emptied(F.col("left")), F.col("a")).alias("a"),
            F.when(~emptied(F.col("left")), F.col("b")).alias("b"),
        ),
        "peeled",
    )
    done = [tried.filter("ok").select("row", "kind", "d")]
    stuck, salt = tried.filter("NOT ok").select("row", "kind", F.lit(0).cast("long").alias("part"), "a", "b"), 0
    while not stuck.isEmpty():
        salt += 1
        tables = F.greatest(F.lit(2), F.ceil((F.size("a") + F.size("b")) / PER_TABLE)).cast("int")
        side = [_signed(F.col(s), n) for s, n in (("a", 1), ("b", -1))]
        dealt = stuck.withColumn("tables", tables).select("row", "kind", "part", "tables", F.explode(F.concat(*side)).alias("x"))
        part = F.xxhash64("part", F.pmod(F.xxhash64("x.k", F.lit(1000 + salt)), "tables"))
        keys = [F.collect_list(F.when(F.col("x.side") == n, F.col("x.k"))).alias(c) for c, n in (("a", 1), ("b", -1))]
        small = dealt.withColumn("part", part).groupBy("row", "kind", "part").agg(*keys)
        small = small.withColumn("left", peel(minus(cells(F.col("a"), salt), cells(F.col("b"), salt)), salt))
        small = stored(
            small.select("row", "kind", "part", emptied(F.col("left")).alias("ok"), F.size("left.found").alias("d"),
                         F.when(~emptied(F.col("left")), F.col("a")).alias("a"), F.when(~emptied(F.col("left")), F.col("b")).alias("b")),
            "peeled",
        )
        done.append(small.filter("ok").select("row", "kind", "d"))
        stuck = small.filter("NOT ok").drop("ok", "d")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found.groupBy("row", "kind").agg(F.sum("d").alias("differing"))


def likeness(a: Column, b: Column, differing: Column) -> Column:
    """Jaccard similarity from the sizes of two sets and of their difference; 1 for two empty sets."""
    union = (F.size(a) + F.size(b) + differing) / 2
    return F.when(union == 0, F.lit(1.0)).otherwise((union - differing) / union)


def _with_next(rows: DataFrame) -> DataFrame:
    """``id, k, n, next_k, times``: each row's next in descending order of id (null last; among
    equal ids by key), the first after the last. Rows that repeat id and text stand next to each
    other: all but one have their own text next."""
    one = rows.groupBy("id", "k", "n").agg(F.count(F.lit(1)).alias("c"))
    order = [F.desc_nulls_last("id"), F.asc("k")]
    placed = stored(
        one.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()),
        "ordered",
    )
    inside = F.lead("k").over(Window.partitionBy("part").orderBy("at"))
    # one row for each partition of the sort
    heads = placed.groupBy("part").agg(F.min_by("k", "at").alias("k"))
    everything = Window.orderBy("part")
    heads = heads.select(
        "part", F.coalesce(F.lead("k").over(everything), F.first("k").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head")
    )
    nexts = placed.withColumn("inside", inside).join(heads, "part").withColumn("next_k", F.coalesce("inside", "head"))
    last = nexts.select("id", "k", "n", "next_k", F.lit(1).cast("long").alias("times"))
    same = placed.filter("c > 1").select("id", "k", "n", F.col("k").alias("next_k"), (F.col("c") - 1).alias("times"))
    return last.unionByName(same)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.

    The edited text has its last floor(n/2) characters replaced by the first as many (or all) of
    the next document's, descending by id, nulls last, the first after the last; rows with
    equal ids follow by the key of their text. Likeness is the Jaccard similarity of the sets of
    paragraph digests, from the difference that peeling recovers. Null texts count as empty (two
    texts without paragraphs are alike, 1). A single row is its own next. Empty tables give an
    empty result; other columns play no part.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("k", text_key(F.col("text")))
    nexts = stored(_with_next(base.select("id", "k", F.length("text").cast("long").alias("n"))), "nexts")
    # each distinct text once, copies combined before the shuffle
    texts = base.groupBy("k").agg(F.first("text").alias("text"))
    need = F.floor(F.col("n") / 2).cast("int")
    tails = nexts.join(texts.withColumnRenamed("k", "next_k"), "next_k").select(
        "id", "k", "n", "times", F.substring(F.col("text"), F.lit(1), need).alias("tail"), digests(F.col("text")).alias("next")
    )
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n") - need).cast("int")), "tail")
    made = tails.join(texts, "k").withColumn("edited", edited).select(
        "id", "n", "times", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("new"), "next"
    )
    made = stored(made.withColumn("row", F.monotonically_increasing_id()), "digests")
    tables = made.select("row", "own", "new", "next", cells(F.col("own")).alias("f_own"), cells(F.col("new")).alias("f_new"), cells(F.col("next")).alias("f_next"))
    kinds = [F.struct(F.lit(kind).alias("kind"), F.col(b).alias("b"), F.col(f"f_{b}").alias("fb")) for kind, b in (("edited", "new"), ("next", "next"))]
    pairs = tables.select("row", F.col("own").alias("a"), F.col("f_own").alias("fa"), F.explode(F.array(*kinds)).alias("p"))
    pairs = pairs.select("row", "a", "fa", "p.kind", "p.b", "p.fb")
    d = differences(pairs).groupBy("row").agg(
        *[F.max(F.when(F.col("kind") == kind, F.col("differing"))).alias(kind) for kind in ("edited", "next")]
    ).withColumnsRenamed({"next": "d_next", "edited": "d_edited"})
    out = made.join(d, "row").select(
        F.col("id").alias(id_col), F.col("n").alias("n_chars"), "edited_sha256",
        as_text(cells(F.col("own"))).alias("fingerprint"), as_text(cells(F.col("new"))).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new"), F.col("d_edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("next"), F.col("d_next")).alias("near_next"), "times",
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times", "copy")
