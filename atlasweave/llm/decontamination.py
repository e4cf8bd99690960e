"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, names and units in documents and benchmark items become typed placeholders, so that a question with
other parameters keeps its template.  Windows of five canonical tokens are joined by hash, and the values
that stand in the placeholders are checked for consistency.  A document is contaminated by an item if at least
COVERED of the item's distinct windows, in one of two forms, occur in it in consistent alignments.

Tokens are runs of letters and digits, with points and commas between digits.  A token that begins with a digit is a number; a
word of UNITS right after a number is a unit; a name is a run of words of a capital and small letters with only white space
between them, one token whatever their number.  The two forms of a text: *named*, with placeholders for names, and *plain*, in which all
letters are small, names are words and only numbers and units are placeholders, so that the case of an item or a document makes
no difference.  A window with fewer than two words is no template: it keeps its values, and so does an item shorter than a
window, which must occur whole.  (A copy in one case with other names has neither form; it is not found.)

Consistency: within one alignment of an item with a document (the same distance of positions) most of the slots must
take part in a mapping from item values to document values that is one to one: for each value the partner that it has most
often (of ties the least) is its partner.  Equal values of an item that get different ones are so tolerated.

Scale: a bitmap of the benchmark's windows (16 bits a window, 2^27 at most) is a scalar subquery, so
nearly all windows of clean documents are dropped right where they are made.  An item becomes a candidate only through its rarest windows, of which a contaminated
document holds at least one, so windows that all items share don't pair all documents with all items.  A benchmark of
checked size is broadcast; windows of a larger one that many documents share are salted by how many they are.

Defined results: null and empty texts have no windows and are clean; null doc_ids are kept; repeated rows get the same answer
each; items without a token take no part; repeated
item_ids are told apart by their text; items tie freely (all are listed); extra columns are ignored; an empty benchmark leaves
every document clean, and empty documents give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, HOT_KEYS, cut_lineage, numbered, own, sized

#: Tokens of a window; percent of an item's windows that must be covered; percent of an alignment's slots that must be consistent.
WINDOW, COVERED, CONSISTENT = 5, 80, 50
#: Log2 of the bits of the benchmark's bitmap, at least and at most.
LEAST_BITS, MOST_BITS = 14, 27
#: Units of measure in lower case.
UNITS = (
    "mm cm m km in ft yd mi mile miles g kg mg lb lbs oz ton tons l ml cl gal s sec second seconds min minute minutes h hr hour hours "
    "day days week weeks month months year years v w kw kwh hz khz mhz ghz kb mb gb tb percent dollar dollars euro euros usd eur cent cents pound pounds ounce ounces foot feet inch "
    "inches yard yards litre litres liter liters metre metres meter meters gram grams kilogram kilograms kilometre kilometres kilometer "
    "kilometers centimetre centimetres degree degrees volt volts watt watts"
).split()
#: Possessive quantifiers change no match; they keep long runs linear and off the stack.
NAMES = r"(?<![\p{L}0-9])(\p{Lu}\p{Ll}++)(?![\p{L}0-9])(?:[ \t\n\r]++\p{Lu}\p{Ll}++(?![\p{L}0-9]))*+"
#: What stands between tokens: all but letters and digits, and points and commas only if not between digits.
GAP = r"(?:[^\p{L}0-9.,@]|[.,](?!(?<=[0-9][.,])[0-9]))++"
NAMED, PLAIN, SHORT = 0, 1, 2
#: Marks before the values of numbers, names and units; they come before all letters.
MARKS = "#@%"


def lines_of(text: Column, names: bool) -> Column:
    """A text's tokens in small letters, one a line; with names the first word of a name stands for it, after its mark."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("@"), F.lit(" "))
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(text, NAMES, "@$1") if names else text, GAP, "\n")), F.lit("\n"))


def marked(lines: Column) -> Column:
    """Lines with marks before numbers and units."""
    return F.regexp_replace(F.regexp_replace(lines, "(?md)^(?=[0-9])", "#"), rf"(?md)^(#[^\n]*+\n)(?=(?:{'|'.join(UNITS)})$)", "$1%")


def windows(rows: DataFrame, text: Column, form: int, short: Sequence[int] = (), bits: Column | None = None, log_bits: int = LEAST_BITS) -> DataFrame:
    """form, at, w (the window's hash) and window (its marked lines) of every window, beside rows' columns.

    short lists the lengths of short items, whose windows are runs of so many plain tokens.  With bits only windows whose bit is set
    are given.  The tokens of a whole text stay in its row; its places are exploded, so that windows are hashed and tested in generated
    code (functions of arrays' elements are interpreted), with the outer form, as for the others Spark pushes a
    filter on the array's size below the projections, with the whole expression in it.
    """
    columns = rows.columns
    rows = rows.withColumn("lines", lines_of(text, form == NAMED)).withColumn("tokens", F.split(marked(F.col("lines")), "\n"))
    rows = rows.withColumn("codes", F.transform("tokens", lambda t: F.xxhash64(F.when(t < "a", F.substring(t, 1, 1)).otherwise(t))))
    kinds = [(form, "codes", WINDOW), *((SHORT, "plain", n) for n in short)]
    least = min(n for _, _, n in kinds)
    if short:
        rows = rows.withColumn("plain", F.split("lines", "\n"))
    starts = F.when((F.size("tokens") >= least) & (F.col("lines") != ""), F.sequence(F.lit(0), F.size("tokens") - least))
    found = rows.select(*columns, *dict.fromkeys(["tokens", *(name for _, name, _ in kinds)]), F.explode_outer(starts).alias("at"))
    hashes = [F.xxhash64(F.lit(f), *(F.get(name, F.col("at") + k) for k in range(n))) for f, name, n in kinds]
    if not short:
        found = found.where(F.col("at").isNotNull()).withColumns({"form": F.lit(form), "length": F.lit(WINDOW), "w": hashes[0]})
    else:  # one row for each kind of window at a place; those that reach beyond the text have no hash
        found = found.where(F.col("at").isNotNull()).withColumn("kind", F.explode(F.array(*map(F.lit, range(len(kinds))))))
        of_kind = lambda values: F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in enumerate(values)))
        found = found.withColumns({"form": of_kind([F.lit(f) for f, _, _ in kinds]), "length": of_kind([F.lit(n) for _, _, n in kinds])})
        found = found.where(F.col("at") + F.col("length") <= F.size("tokens")).withColumn("w", of_kind(hashes))
    if bits is not None:
        word = F.get(bits, F.shiftrightunsigned("w", 64 - log_bits + 6).cast("int"))
        found = found.where(F.getbit(word, F.col("w").bitwiseAND(63).cast("int")) == 1)
    return found.select(*columns, "form", "at", "w", F.slice("tokens", F.col("at") + 1, F.col("length")).alias("window"))


def exact(window: Column, form: Column) -> Column:
    """The hash of a window with its values."""
    return F.xxhash64(form, F.lit("exact"), window)


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, list[int]]:
    """item, item_id, form, at, w, id, poor, window and n of all windows, and the lengths of short items.

    A poor window has fewer than two words; its id is the hash with values, that of others is w.  n is the number of the item's ids.
    """
    items = benchmark.select(own(benchmark, id_col).alias("item_id"), own(benchmark, text_col).alias("text")).where(F.col("text").isNotNull()).distinct()
    plain = lines_of(F.col("text"), False)
    items = items.where(plain != "").select("item_id", F.xxhash64(F.col("item_id").isNull(), "item_id", "text").alias("item"), "text", F.size(F.split(plain, "\n")).alias("size"))
    items = cut_lineage(items)
    short = sorted(r.size for r in items.where(F.col("size") < WINDOW).select("size").distinct().collect())  # WINDOW - 1 rows at most
    found = windows(items, F.col("text"), NAMED).unionByName(windows(items, F.col("text"), PLAIN, short))
    # of the short forms only the window of the item's own length is the item whole
    found = found.where((F.col("form") != SHORT) | (F.size("window") == F.col("size"))).drop("text", "size")
    poor = (F.col("form") != SHORT) & (F.size(F.filter("window", lambda t: t >= "a")) < 2)
    found = cut_lineage(found.withColumn("poor", poor).withColumn("id", F.when(poor, exact(F.col("window"), F.col("form"))).otherwise(F.col("w"))))
    return cut_lineage(found.join(found.groupBy("item", "form").agg(F.countDistinct("id").alias("n")), ["item", "form"])), short


def bitmap(found: DataFrame, log_bits: int) -> DataFrame:
    """One row with an array of 2^(log_bits - 6) longs: the bits that the windows' hashes select."""
    words = found.groupBy(F.shiftrightunsigned("w", 64 - log_bits + 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(w & 63 as int))")).alias("word"))
    every = found.sparkSession.range(1 << (log_bits - 6), numPartitions=1).join(words, "id", "left").select(F.struct("id", F.coalesce("word", F.lit(0).cast("long")).alias("word")).alias("x"))
    return every.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.word).alias("bits"))


def on_window(hits: DataFrame, items: DataFrame, small: bool) -> DataFrame:
    """hits joined with rows of the benchmark by w: a small benchmark is broadcast, else windows that many hits share are salted."""
    if small:
        return hits.join(F.broadcast(items), "w")
    counts, least = hits.groupBy("w").agg(F.count("*").alias("n")), max(1, hits.count() // HOT_KEYS)
    hot = F.broadcast(cut_lineage(counts.where(F.col("n") > least).select("w", F.ceil(F.col("n") / least).cast("int").alias("salts"))))  # HOT_KEYS rows at most
    salts = F.coalesce("salts", F.lit(1))
    left = hits.join(hot, "w", "left").withColumn("salt", F.pmod(F.xxhash64("file", "row", "at"), salts).cast("int")).drop("salts")
    right = items.join(hot, "w", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return left.join(right, ["w", "salt"]).drop("salt")


def consistent(joined: DataFrame) -> DataFrame:
    """file, row, item, form and shift of the alignments that have slots, most of which map one to one."""
    key = ["file", "row", "item", "form", "shift"]
    zipped = F.arrays_zip(F.col("item_window").alias("a"), F.col("window").alias("b"))
    slots = joined.where("slotted").select(*key, "item_at", F.posexplode(zipped).alias("p", "v")).where(F.col("v.a") < "a")
    pairs = slots.select(*key, F.expr("item_at + p").alias("place"), F.col("v.a").alias("a"), F.col("v.b").alias("b")).distinct().groupBy(*key, "a", "b").agg(F.count("*").alias("c"))
    first = lambda x, y: F.row_number().over(Window.partitionBy(*key, x).orderBy(F.desc("c"), y)) == 1
    marked = pairs.withColumn("mapped", first("a", "b")).withColumn("back", first("b", "a"))
    share = F.sum(F.when(F.col("mapped") & F.col("back"), F.col("c")).otherwise(0)) * 100 >= CONSISTENT * F.sum("c")
    return marked.groupBy(*key).agg(share.alias("ok")).where("ok").drop("ok")


def hits(rows: DataFrame, form: int, items: DataFrame, short: Sequence[int], small: bool) -> DataFrame:
    """file, row, form, at, id and window of the windows of rows (file, row, text) that items hold."""
    known = cut_lineage(items.select("w", "id", "poor").distinct())
    log_bits = min(MOST_BITS, max(LEAST_BITS, (16 * known.count()).bit_length()))
    rows = rows.withColumn("bits", bitmap(known, log_bits).scalar())
    found = cut_lineage(windows(rows, F.col("text"), form, short, F.col("bits"), log_bits).drop("text", "bits"))
    rich = on_window(found, known.where("NOT poor").select("w").distinct(), small).withColumn("id", F.col("w"))
    valued = found.withColumn("w", exact(F.col("window"), F.col("form")))
    poor = on_window(valued, known.where("poor").select(F.col("id").alias("w")).distinct(), small).withColumn("id", F.col("w"))
    return rich.unionByName(poor).drop("w")


def contaminated(docs: DataFrame, names: list[str], benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """file, row (a row's name), item, item_id of every pair of a document and an item in it; docs is numbered by the names.

    The plain form of every document is made.  A window without a name is the same in both forms, and a document that holds an item in
    the named form misses few of its windows; so if an item has more windows without a name than may be missed, only documents with
    one of them, which is among their plain hits, need the named form.  Where items have fewer, all documents get it.
    """
    items, short = item_windows(benchmark, item_id_col, item_text_col)
    small = items.count() <= BROADCAST_ROWS
    rows = docs.select(own(docs, names[0]).alias("file"), own(docs, names[1]).alias("row"), own(docs, text_col).alias("text"))
    free = F.countDistinct(F.when(~F.exists("window", lambda t: F.startswith(t, F.lit("@"))), F.col("id")))
    named = items.where(F.col("form") == NAMED)
    dense = named.groupBy("item", "n").agg(free.alias("free")).where(f"free <= n - (n * {COVERED} + 99) div 100")

    # plain hits of windows of either form: a named window without a name has the hash of its plain twin
    twins = named.where(~F.exists("window", lambda t: F.startswith(t, F.lit("@")))).withColumn("form", F.lit(PLAIN))
    twins = twins.withColumn("w", F.xxhash64("form", *(F.xxhash64(F.when(F.get("window", F.lit(k)) < "a", F.substring(F.get("window", F.lit(k)), 1, 1)).otherwise(F.get("window", F.lit(k)))) for k in range(WINDOW))))
    twins = twins.withColumn("id", F.when(F.col("poor"), exact(F.col("window"), F.col("form"))).otherwise(F.col("w")))
    plain = cut_lineage(hits(rows, PLAIN, items.where(F.col("form") != NAMED).unionByName(twins.select(*items.columns)), short, small))
    second = rows.join(sized(plain.select("file", "row").distinct()), ["file", "row"]) if dense.isEmpty() else rows
    found = cut_lineage(plain.unionByName(hits(second, NAMED, named, (), small)))

    # the rarest windows of each item: missing all of them means missing more than a contaminated document may
    spread = items.groupBy("id").agg(F.countDistinct("item").alias("spread"))
    each = items.select("item", "form", "n", "id").distinct().join(spread, "id").groupBy("item", "form", "n").agg(F.array_sort(F.collect_list(F.struct("spread", "id"))).alias("ids"))
    rare = each.select("item", "form", F.explode(F.slice("ids", F.lit(1), F.expr(f"n - (n * {COVERED} + 99) div 100 + 1").cast("int"))).alias("x")).select("item", F.col("x.id").alias("w"))
    candidates = on_window(found.select("file", "row", "at", F.col("id").alias("w"), "form"), cut_lineage(rare), small).select("file", "row", "form", "item").distinct()

    other = items.select("item", "item_id", "form", "id", "n", F.col("window").alias("item_window"), F.col("at").alias("item_at"), (F.exists("window", lambda t: t < "a") & ~F.col("poor") & (F.col("form") != SHORT)).alias("slotted"))
    joined = found.join(candidates, ["file", "row", "form"]).join(F.broadcast(other) if small else other, ["item", "form", "id"])
    joined = cut_lineage(joined.withColumn("shift", F.col("at") - F.col("item_at")))
    kept = joined.join(consistent(joined).withColumn("ok", F.lit(True)), ["file", "row", "item", "form", "shift"], "left").where("NOT slotted OR ok")
    covered = kept.groupBy("file", "row", "item", "item_id", "form", "n").agg(F.countDistinct("id").alias("covered"))
    return covered.where(f"100 * covered >= {COVERED} * n").select("file", "row", "item", "item_id").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, contaminated, n_items and item_ids (sorted, comma-joined) of every row of docs."""
    rows, names = numbered(docs)
    found = contaminated(rows, names, benchmark, text_col, item_id_col, item_text_col)
    listed = found.groupBy("file", "row").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",", "null").alias("item_ids"))
    ids = rows.select(own(rows, names[0]).alias("file"), own(rows, names[1]).alias("row"), own(rows, id_col).cast("long").alias("doc_id"))
    return ids.join(listed, ["file", "row"], "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("item_ids", F.lit("")).alias("item_ids")
    )
