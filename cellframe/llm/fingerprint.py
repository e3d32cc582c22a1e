"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in SQL functions only.

A text's paragraphs (runs of up to ``RUN`` sentences of one line) are hashed to distinct 64-bit
digests. A sketch has twelve cells in three tables of four; every digest goes to one cell of
each table, which holds the number of its digests, the exclusive or of them, and the exclusive
or of their check hashes. The sketch of twelve cells is the text's fingerprint: equal texts have
equal ones, and its size does not follow the text's.

Two fingerprints are subtracted cell by cell; paragraphs that both texts hold cancel out. Cells
with one digest left are peeled until none remains, which gives the paragraphs of either side.
If peeling gets stuck, the difference was too large for twelve cells: the sketch is built anew
eight times as large, as eight blocks of twelve cells chosen by three more bits of the digest,
and blocks that get stuck are split again. After 21 levels all bits are used, so this ends.

All of it is expressions over one row's arrays, whose cost follows the number of paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage_cut import cut

#: sentences of a line that make one paragraph at most
RUN = 2
CELLS = 12
PARAGRAPH = rf"(?:[^\n.!?]++[.!?]*+){{1,{RUN}}}+|[.!?]++"

# cells of a digest as a bit mask, one in each table of four, by six bits of a second hash
_MASKS = "array(" + ",".join(str(1 << (i & 3) | 16 << (i >> 2 & 3) | 256 << (i >> 4 & 3)) for i in range(64)) + ")"


def _mask(d: str) -> str:
    return f"element_at({_MASKS}, cast(1 + (xxhash64({d}, 7) & 63) as int))"


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def digests(text: Column) -> Column:
    """Sorted distinct digests of the paragraphs of a text; none for a null or blank text."""
    parts = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0)), lambda u: F.trim(u))
    return F.sort_array(F.array_distinct(F.transform(F.filter(parts, lambda u: u != ""), lambda u: F.xxhash64(u))))


def _signed(name: str, sign: int) -> str:
    return f"transform({name}, d -> named_struct('s', {sign}, 'd', d, 'm', {_mask('d')}, 'h', hash(d)))"


def _cells(signed: str) -> str:
    add = "named_struct('c', a.c + s.s, 'k', a.k ^ s.d, 'h', a.h ^ s.h)"
    return (f"transform(sequence(0, {CELLS - 1}), i -> aggregate(filter({signed}, s -> getbit(s.m, i) = 1), "
            f"named_struct('c', 0, 'k', 0L, 'h', 0), (a, s) -> {add}))")


def _peel(cells: str) -> str:
    """(p, m, ok): digests of the first and the second side that peeling finds, and whether nothing is left."""
    pure = "array_distinct(transform(filter(st.cells, e -> abs(e.c) = 1 AND e.h = hash(e.k)), e -> named_struct('c', e.c, 'k', e.k)))"
    less = "named_struct('c', a.c - y.c, 'k', a.k ^ y.k, 'h', a.h ^ hash(y.k))"
    cleared = f"transform(st.cells, (e, i) -> aggregate(filter(q, y -> getbit({_mask('y.k')}, i) = 1), e, (a, y) -> {less}))"
    peeled = (f"if(size(q) = 0, named_struct('cells', st.cells, 'p', st.p, 'm', st.m, 'go', false), named_struct('cells', {cleared}, "
              "'p', st.p + size(filter(q, y -> y.c = 1)), 'm', st.m + size(filter(q, y -> y.c = -1)), 'go', true))")
    rounds = (f"aggregate(sequence(1, {CELLS}), named_struct('cells', {cells}, 'p', 0, 'm', 0, 'go', true), "
              f"(st, r) -> if(st.go, {_let(pure, 'q', peeled)}, st), "
              "st -> named_struct('p', st.p, 'm', st.m, 'ok', forall(st.cells, e -> e.c = 0 AND e.k = 0 AND e.h = 0)))")
    return rounds


def sketch(name: str) -> Column:
    """The twelve cells of the digests in column ``name``."""
    return F.expr(_cells(_signed(name, 1)))


def printed(cells: str) -> Column:
    """A sketch as text: of each cell the number, the digests and the checks, in hexadecimal."""
    return F.array_join(F.transform(cells, lambda c: F.concat(
        F.lpad(F.hex(c["c"]), 4, "0"), F.lpad(F.hex(c["k"]), 16, "0"), F.lpad(F.hex(c["h"].cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0"))), "")


def difference(cells_a: str, cells_b: str, digests_a: str, digests_b: str) -> Column:
    """(p, m): numbers of paragraphs that only the first and only the second text holds."""
    first = _peel(f"zip_with({cells_a}, {cells_b}, (x, y) -> named_struct('c', x.c - y.c, 'k', x.k ^ y.k, 'h', x.h ^ y.h))")
    split = ("filter(flatten(transform(st.todo, b -> transform(sequence(0, 7), j -> filter(b, s -> "
             "(shiftrightunsigned(s.d, 3 * l) & 7) = j)))), b -> size(b) > 0)")
    tried = f"transform({split}, b -> named_struct('b', b, 'r', {_peel(_cells('b'))}))"
    total = "aggregate(filter(t, x -> x.r.ok), st.{0}, (a, x) -> a + x.r.{0})"
    step = f"named_struct('todo', transform(filter(t, x -> NOT x.r.ok), x -> x.b), 'p', {total.format('p')}, 'm', {total.format('m')})"
    larger = (f"aggregate(sequence(0, 20), named_struct('todo', array(concat({_signed(digests_a, 1)}, {_signed(digests_b, -1)})), 'p', 0, 'm', 0), "
              f"(st, l) -> if(size(st.todo) = 0, st, {_let(tried, 't', step)}), st -> named_struct('p', st.p, 'm', st.m))")
    return F.expr(_let(first, "f", f"if(f.ok, named_struct('p', f.p, 'm', f.m), {larger})"))


def likeness(diff: str, digests_a: str) -> Column:
    """Share of all paragraphs of two texts that both hold; 1 if neither has any."""
    n = F.size(digests_a)
    every = n + F.col(f"{diff}.m")
    return F.when(every == 0, 1.0).otherwise((n - F.col(f"{diff}.p")) / every)


def followers(rows: DataFrame) -> DataFrame:
    """The row that follows each row by (doc_id, h1, h2), after the last the first: (h1, h2, n1, n2, half).

    Rows are range-partitioned; each partition finds its own followers, and only the first
    rows of the partitions meet. Equal rows count once.
    """
    order = ["doc_id", "h1", "h2"]
    ranged = rows.distinct().repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = cut(ranged.select(*order, "half", "part"))
    firsts = ranged.groupBy("part").agg(F.min(F.struct(*order)).alias("first"))
    whole = W.orderBy("part")
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(whole), F.min("first").over(whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("beyond"))
    own = F.lead(F.struct(*order)).over(W.partitionBy("part").orderBy(*(F.col(c).asc_nulls_first() for c in order)))
    found = ranged.withColumn("own", own).join(firsts, "part").withColumn("next", F.coalesce("own", "beyond"))
    return cut(found.select("h1", "h2", F.col("next.h1").alias("n1"), F.col("next.h2").alias("n2"), "half"))


def edited_fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, and how like it is to that and to the next document.

    The edited form has the last half of the characters (rounded down) replaced by as many
    first ones of the next document by id. Null texts count as empty; rows of equal id are
    ordered by row hash and rows equal in both share their successor; null ids come first.
    """
    named = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = named.withColumns({"h1": F.xxhash64("doc_id", "text"), "h2": F.hash("text")})
    after = followers(named.select("doc_id", "h1", "h2", F.floor(F.length("text") / 2).cast("int").alias("half")))
    base = named.select("doc_id", "text", "h1", "h2")
    # each document as the next one of its predecessor
    given = base.join(after.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("n1").alias("h1"), F.col("n2").alias("h2"), "half"), ["h1", "h2"])
    given = given.select("p1", "p2", F.col("doc_id").alias("next_id"), F.expr("substring(text, 1, half)").alias("head"), digests(F.col("text")).alias("next_digests"))
    given = given.groupBy("p1", "p2").agg(F.first("next_id").alias("next_id"), F.first("head").alias("head"), F.first("next_digests").alias("next_digests"))
    both = base.join(given.withColumnsRenamed({"p1": "h1", "p2": "h2"}), ["h1", "h2"])
    both = both.withColumn("n_chars", F.length("text"))
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, n_chars - cast(floor(n_chars / 2) as int))"), "head"))
    both = both.select("doc_id", "next_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       digests(F.col("text")).alias("own_digests"), digests(F.col("edited")).alias("edited_digests"), "next_digests")
    both = both.withColumns({f"{x}_cells": sketch(f"{x}_digests") for x in ("own", "edited", "next")})
    both = both.withColumns({f"{x}_diff": difference("own_cells", f"{x}_cells", "own_digests", f"{x}_digests") for x in ("edited", "next")})
    return both.select("doc_id", "n_chars", "edited_sha256", printed("own_cells").alias("fingerprint"), printed("edited_cells").alias("edited_fingerprint"),
                       likeness("edited_diff", "own_digests").alias("near_edited"), likeness("next_diff", "own_digests").alias("near_next"),
                       "next_id", F.size("own_digests").cast("long").alias("n_paragraphs"))
