"""Operator 6: document fingerprints of closed syncmers, on built-in expressions only.

A text is a sequence of units, folded to lower case: runs of at most RUN code points between white space, and single characters of
scripts written without spaces. Each K consecutive units hold K - S + 1 inner sequences of S units; the K-mer is an anchor if the
least inner hash is the first or the last of them. That depends on the K units alone, so the same passage gives the same
anchors at the same distances wherever it stands, and no gap between anchors exceeds K - S units in random text. A text of
fewer than FEW units has a second, finer level besides: anchors of FINE_K consecutive code points with inner sequences of FINE_S,
so that short texts share anchors too. The fingerprint is the list of 32-bit anchor hashes with their places in order.

Likeness of two fingerprints is positional: anchors that both have (the first of equal ones) give pairs of places, and only pairs whose
distance agrees, within a band of a sixteenth of the longer text, with the commonest one count. The number of these divided by the
number of different anchors of both is the likeness, from 0 to 1. It is taken from the finer level if both have it. Passages that are
moved further than the band, such as a text in reverse order, do not count as alike.

The next document by id is found without a global window: ids fall into cells of 2^CELL_BITS, the first document of each cell
is copied as a guest to the cell before it, and a window over a cell reads the next row. The order of cells is found
the same way, level by level. A document is shuffled once, and one in a cell twice.

Defined results: null text is empty; an empty text has an empty fingerprint, and two of them are alike (1). A sequence shorter than
its K has no anchor on that level but the whole of it on the finer one. The document after the last is the first. Rows with one id follow each other by text
hash. A null id has no place in the order; its next document is itself. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tribolens.llm.columns import let, small_side
from tribolens.plans.storage import materialise

K, S = 8, 2
FINE_K, FINE_S, FEW = 6, 3, 48
RUN = 16
BAND = 16
# Blocks of scripts written without spaces (Thai and Lao, Myanmar, Khmer, Kana, Han).
UNSPACED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
UNITS = rf"[^\x20\x09-\x0D{UNSPACED}]{{1,{RUN}}}|[{UNSPACED}]"
CELL_BITS, LEVEL_BITS = 6, 12
ANCHOR_BITS, PLACE_BITS = 32, 30


def anchors(text: Column) -> Column:
    """Closed syncmers of a text, each as one long: place in the upper half, anchor hash in the lower, whose last bit is its level."""
    def of_units(units: Column) -> Column:
        return F.concat(closed_syncmers(units, K, S, 0), F.when(
            F.size(units) < FEW, fine(F.array_join(units, " "))).otherwise(F.array().cast("array<long>")))

    return let(F.regexp_extract_all(F.lower(text), F.lit(UNITS), F.lit(0)), of_units)


def fine(text: Column) -> Column:
    """Anchors of code points; a shorter text is one anchor."""
    whole = F.when(text != "", F.array(placed(F.lit(0), F.xxhash64(text), 1))).otherwise(F.array().cast("array<long>"))
    return F.when(F.length(text) >= FINE_K, closed_syncmers(F.split(text, ""), FINE_K, FINE_S, 1)).otherwise(whole)


def closed_syncmers(units: Column, k: int, s: int, level: int) -> Column:
    span = k - s
    # Inner sequences that together cover the K-mer.
    cover = sorted({*range(0, span + 1, s), span})

    def closed(inner: Column) -> Column:
        def is_anchor(i: Column) -> Column:
            between = F.least(*(F.get(inner, i + j) for j in range(1, span)))
            return F.least(F.get(inner, i), F.get(inner, i + span)) <= between

        places = F.filter(F.sequence(F.lit(0), F.size(inner) - 1 - span), is_anchor)
        return F.transform(places, lambda i: placed(i, F.xxhash64(*(F.get(inner, i + j) for j in cover)), level))

    def inner_hashes(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(s))))

    def of_hashes(h: Column) -> Column:
        return F.when(F.size(h) >= k, let(inner_hashes(h), closed)).otherwise(F.array().cast("array<long>"))

    return let(F.transform(units, lambda u: F.xxhash64(u)), of_hashes)


def placed(place: Column, hash_: Column, level: int) -> Column:
    own = F.shiftleft(F.shiftrightunsigned(hash_, 65 - ANCHOR_BITS), 1) + level
    return F.shiftleft(place.cast("long"), ANCHOR_BITS).bitwiseOR(own)


def anchor_of(item: Column) -> Column:
    return item.bitwiseAND((1 << ANCHOR_BITS) - 1)


def likeness(a: Column, b: Column) -> Column:
    """Share of the different anchors of both that both have at their commonest distance."""
    def has_fine(items: Column) -> Column:
        return F.exists(items, lambda x: x.bitwiseAND(1) == 1)

    def keyed(items: Column, side: int, level: Column) -> Column:
        # Anchor, side and place in one number: one sort brings equal anchors together, those of `a` first.
        return F.transform(F.filter(items, lambda x: x.bitwiseAND(1) == level), lambda x: F.shiftleft(
            anchor_of(x), PLACE_BITS + 1).bitwiseOR(F.shiftrightunsigned(x, ANCHOR_BITS)) + (side << PLACE_BITS))

    def place(x: Column) -> Column:
        return x.bitwiseAND((1 << PLACE_BITS) - 1)

    def same(x: Column, y: Column, bits: int) -> Column:
        return F.shiftrightunsigned(x, bits) == F.shiftrightunsigned(y, bits)

    def firsts(items: Column) -> Column:
        return F.filter(items, lambda x, i: (i == 0) | ~same(x, F.get(items, i - 1), PLACE_BITS))

    def compared(items: Column) -> Column:
        # Of equal anchors at most one of each side is left, side by side.
        met = F.filter(F.transform(items, lambda x, i: F.when(
            same(x, F.get(items, i - 1), PLACE_BITS + 1), place(x) - place(F.get(items, i - 1)))), lambda d: d.isNotNull())
        last = F.array_max(F.transform(items, place))
        band = F.greatest(F.lit(4), F.floor(last / BAND))
        # The band is computed once: inside the lambda it would be computed for each distance.
        banded = let(band, lambda width: F.transform(met, lambda x: F.floor(x / width)))
        return let(banded, lambda d: F.try_divide(commonest(F.sort_array(d)).cast("double"), F.size(items) - F.size(d)))

    def of_level(level: Column) -> Column:
        return let(F.sort_array(F.concat(keyed(a, 0, level), keyed(b, 1, level))), lambda items: let(firsts(items), compared))

    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(
        F.coalesce(let((has_fine(a) & has_fine(b)).cast("long"), of_level), F.lit(0.0)))


def commonest(bands: Column) -> Column:
    """Most values in two neighbouring bands of a sorted array."""
    start = F.struct(F.lit(0).cast("long").alias("band"), F.lit(0).alias("n"), F.lit(0).alias("before"), F.lit(0).alias("most"))

    def step(state: Column, band: Column) -> Column:
        stays = (state["n"] > 0) & (band == state["band"])
        before = F.when(stays, state["before"]).when(band == state["band"] + 1, state["n"]).otherwise(0)
        n = F.when(stays, state["n"] + 1).otherwise(1)
        return F.struct(band.alias("band"), n.alias("n"), before.alias("before"), F.greatest(state["most"], n + before).alias("most"))

    return F.aggregate(bands, start, step)["most"]


def listed(found: Column) -> Column:
    """Fingerprint as text: place and anchor in hexadecimal, in order."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", F.hex(F.shiftright(s, ANCHOR_BITS)), F.hex(anchor_of(s)))), ",")


def following(keys: DataFrame) -> DataFrame:
    """(key, next_key) of distinct long keys; the next of the last is null. No window sees more than 2^LEVEL_BITS keys."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None or high - low < 1 << LEVEL_BITS:
        return keys.select("key", F.lead("key").over(Window.partitionBy(F.lit(0)).orderBy("key")).alias("next_key"))
    cells = materialise(keys.groupBy(F.shiftright(F.col("key") - low, LEVEL_BITS).alias("cell")).agg(
        F.min("key").alias("first")))
    after = following(cells.select(F.col("cell").alias("key")))
    heads = after.join(cells.select(F.col("cell").alias("next_key"), "first"), "next_key", "left").select(
        F.col("key").alias("cell"), F.col("first").alias("later"))
    keys = keys.withColumn("cell", F.shiftright(F.col("key") - low, LEVEL_BITS))
    inside = F.lead("key").over(Window.partitionBy("cell").orderBy("key"))
    return keys.withColumn("inside", inside).join(heads, "cell", "left").select(
        "key", F.coalesce("inside", "later").alias("next_key"))


def with_next(docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Documents with `columns` added, and with the text and these columns of the next one by id, named next_*."""
    names = ["text", *columns]
    known = docs.filter("doc_id is not null").withColumn("cell", F.shiftright("doc_id", CELL_BITS))
    cells = materialise(known.groupBy("cell").agg(F.min("doc_id").alias("doc_id")))
    after = following(cells.select(F.col("cell").alias("key")))
    first = cells.agg(F.min("cell")).first()[0]
    heads = small_side(materialise(after.select(F.col("key").alias("to"), F.coalesce("next_key", F.lit(first)).alias("cell"))
                                   .join(cells, "cell").select("doc_id", "to")))
    guests = known.join(heads, "doc_id").withColumn("cell", F.col("to")).drop("to").withColumn("guest", F.lit(1))
    order = Window.partitionBy("cell").orderBy("guest", "doc_id", F.hash("text"))
    rows = known.withColumn("guest", F.lit(0)).unionByName(guests).withColumns(columns).select(
        "*", *(F.lead(c).over(order).alias(f"next_{c}") for c in names)).filter("guest = 0").drop("guest", "cell")
    alone = docs.filter("doc_id is null").withColumns(columns).select("*", *(F.col(c).alias(f"next_{c}") for c in names))
    return rows.unionByName(alone)


def edited(text: Column, following_text: Column) -> Column:
    """The text with its last quarter replaced by as many code points from the head of the next."""
    part = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - part), F.substring(following_text, F.lit(1), part))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, anchors, edited text, its anchors and the anchors of the next document."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, {"anchors": anchors(F.col("text"))}).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    return rows.select("doc_id", "text", "anchors", "edited", anchors(F.col("edited")).alias("edited_anchors"), "next_anchors")
