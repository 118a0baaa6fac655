"""Line dedup: an exact set-similarity join over the words of lines.

A line is the set of its lower-cased words. It goes if a line before it, by (doc_id, line number), has Jaccard similarity of
0.8 or more to it, whether that line itself stays or not; lines without words stay. The way there, in built-in functions only:

1. Lines are split into words once; the 64-bit hashes of each line's distinct words are written as plain rows, from which all that
   follows is read. Sets are compared by these hashes.
2. Words are ordered by rarity: counts over all lines in BUCKETS hash buckets (a table of fixed size, written as one row), in classes by logarithm, ties by the word's hash. That is one total order for all lines, which is all that
   prefix filtering needs to be exact.
3. Lines with equal sets become one, at the earliest place.
4. Two sets this similar share a word among the first size - ceil(0.8 size) + 1 in that order. Along each of FEW of
   these words, among sets of about its size, a set meets the first and the NEAR before it. This settles most variants of one line.
5. Sets not decided so far meet all before them that share a word of the prefix, if sizes, the positions of the word and 128 parity
   bits allow the similarity: the bits that differ are at most the words that differ. One shuffle serves both sides.
   Where a word's list is far longer than others, its rows are keyed by the word and each next word of the prefix, since similar
   sets that differ share two words there; so a word that a third of all lines have is not one list.
6. Pairs are verified on whole sets, after either step.

Null text stays null. Null doc_id comes last. Where a doc_id repeats, a line number stays if the line at it stays in any of the
rows; rows at the same place leave one another alone. A document whose lines all go stays, with an empty text. Columns n_lines,
n_removed and text of the input are replaced, others are kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import constant, cut, dropped, laid, release, sieve, table, written

BUCKETS, FEW, NEAR, LAST = 1 << 18, 3, 3, (1 << 63) - 1
#: A word is far more frequent in prefixes than others if its bucket holds this many rows, and this many times the mean.
FULL, HOT_ROWS, HOT_TIMES, SALTS = 1 << 16, 4096, 16, 64
#: Lines' white space but for the space itself and the newline.
CONTROLS = ("\t", "\x0b", "\x0c", "\r")
MASK = (1 << 56) - 1
#: More than the lines of any text, for a place as one number.
PLACES = 1 << 31


def shift_left(x: Column, n: Column | int) -> Column:
    return F.call_function("shiftleft", x, n if isinstance(n, Column) else F.lit(n))


def hashed_lines(docs: DataFrame) -> DataFrame:
    """(doc, line, w) of each line with words: its number, and the hashes of its distinct words."""
    odd = reduce(Column.__or__, [F.contains("text", F.lit(c)) for c in CONTROLS])
    plain = F.when(odd, F.regexp_replace("text", r"[\x09\x0B-\x0D]", " ")).otherwise(F.col("text"))
    lines = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.posexplode(F.split(plain, "\n", -1)).alias("line", "body")).where(F.trim("body") != "")
    w = F.array_except(F.transform(F.split(F.lower("body"), " ", -1), lambda x: F.xxhash64(x)), F.array(F.xxhash64(F.lit(""))))
    return lines.select("doc", "line", w.alias("w"))


def parity(words: Column) -> Column:
    """64 bits: which remainders occur an odd number of times."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(shift_left(F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))))


def bucket(x: Column, n: int = BUCKETS) -> Column:
    return x.bitwiseAND(F.lit(n - 1)).cast("int")


def rarity(lines: DataFrame) -> tuple[Column, int]:
    """By bucket of a word's hash its class, 1 to 126, rare first, in the highest byte; and the class that halves the words."""
    counts = lines.select(F.explode("w").alias("x")).groupBy(bucket(F.col("x")).alias("k")).count()
    classes = cut(counts.select("k", "count", F.least(F.lit(126), (1 + 4 * F.log2(F.col("count") + 1)).cast("int")).cast("long").alias("class")))
    per = sorted(classes.groupBy("class").agg(F.sum("count")).collect())
    sums = list(accumulate(n for _, n in per))
    half = next((c for (c, _), n in zip(per, sums, strict=True) if 2 * n >= sums[-1]), 0)
    return constant(classes.select("k", shift_left(F.col("class"), 56).alias("x")), BUCKETS), half


def distinct_sets(lines: DataFrame) -> DataFrame:
    """(doc, line, size, prefix, rare, usual) of each distinct set, at its earliest place.

    rare and usual are parity bits of its rarer and its more usual words; the prefix has one word more than the join needs.
    """
    known, half = rarity(lines)
    # Stands between the rarer and the more usual words; a word of that class whose hash ends in 56 zero bits would do no harm but there.
    middle = F.lit((half + 1) << 56)
    # A subquery may not stand in a lambda as written, so it is a column that only the lambda uses; the optimizer puts it there.
    # Numbers that are never null, by their type, are sorted as such; else as objects by a comparator.
    words = F.transform("w", lambda x: F.coalesce(F.get("known", bucket(x)).bitwiseOR(x.bitwiseAND(F.lit(MASK))), F.lit(0).cast("long")))
    rows = lines.withColumn("known", known).select("doc", "line", F.sort_array(F.concat(words, F.array(middle))).alias("s"))
    rows = rows.select("doc", "line", "s", F.array_position("s", middle).cast("int").alias("k"), (F.size("s") - 1).alias("size"))
    # Slices are columns that are used twice, so that they stay out of the interpreted functions over them.
    rows = rows.select("doc", "line", "s", "size", F.slice("s", F.lit(1), F.col("k") - 1).alias("a"), F.slice("s", F.col("k") + 1, F.col("size")).alias("b"), F.slice("s", F.lit(1), first_words(F.col("size")) + 2).alias("c"))
    bits = lambda part: F.when(F.size(part) > 0, parity(F.col(part))).otherwise(0)
    # The prefix only finds candidates, so 31 bits of a word are enough in it.
    prefix = F.when(F.size("c") > 0, F.transform(F.slice(F.array_remove("c", middle), F.lit(1), first_words(F.col("size")) + 1), lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")))
    # Places as one number each, and all else as keys, so that the aggregation hashes and need not sort.
    near, far = places(F.col("doc"), F.col("line"))
    rows = rows.select(F.xxhash64("s").alias("h"), F.col("size").cast("long").alias("size"), prefix.alias("prefix"), bits("a").alias("rare"), bits("b").alias("usual"), near.alias("near"), far.alias("far"))
    one = rows.groupBy("h", "size", "prefix", "rare", "usual").agg(F.min("near").alias("near"), F.min("far").alias("far"))
    doc, line = place_of("near", "far")
    return one.select(doc.alias("doc"), line.alias("line"), "size", "prefix", "rare", "usual")


def places(doc: Column, line: Column) -> tuple[Column, Column]:
    """A place as one number: a long if doc has 33 bits at most, else a decimal; the other is null."""
    fits = doc.between(-(1 << 32), (1 << 32) - 1)
    far = (doc.cast("decimal(20,0)") * F.lit(PLACES) + line).cast("decimal(38,0)")
    return F.when(fits, shift_left(doc, 31).bitwiseOR(line.cast("long"))), F.when(~fits, far)


def place_of(near: str, far: str) -> tuple[Column, Column]:
    """doc and line of the earlier of two places, as places() has them."""
    at = F.pmod(far, F.lit(PLACES))
    other = F.col(far).isNotNull() & (F.col(near).isNull() | (F.col(far) < 0))
    doc = F.when(other, ((F.col(far) - at) / F.lit(PLACES)).cast("long")).otherwise(F.call_function("shiftright", F.col(near), F.lit(31)))
    return doc, F.when(other, at.cast("int")).otherwise(F.col(near).bitwiseAND(F.lit(PLACES - 1)).cast("int"))


def first_words(size: Column) -> Column:
    return (size - F.floor((4 * size + 4) / 5) + 1).cast("int")


def possible(u: str, y: str) -> Column:
    """Sizes, the positions of a shared word, and parity bits that allow Jaccard 0.8, or 9 * overlap >= 4 * (sum of sizes)."""
    c = lambda side, name: F.col(f"{side}{name}")
    us, ys = c(u, "size"), F.abs(c(y, "size"))
    apart = sum(F.bit_count(c(u, b).bitwiseXOR(c(y, b))) for b in ("rare", "usual"))
    return (5 * us >= 4 * ys) & (5 * ys >= 4 * us) & (9 * F.least(us - c(u, "i"), ys - c(y, "i")) >= 4 * (us + ys)) & (us + ys >= 9 * apart)


def verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, line, bits) of the later sets of the pairs (doc, line, bits, ydoc, yline, ybits) that are similar."""
    used = pairs.select(F.explode(F.array(F.struct("doc", "line", "bits"), F.struct(F.col("ydoc").alias("doc"), F.col("yline").alias("line"), F.col("ybits").alias("bits")))).alias("x")).select("x.*").distinct()
    known = sieve(used, "doc", "line")
    # Where a doc_id repeats, the bits tell the lines at one place apart.
    full = lines.where(known(F.col("doc"), F.col("line"))).withColumn("bits", parity(F.col("w"))).join(used, ["doc", "line", "bits"], "left_semi")
    both = pairs.join(full, ["doc", "line", "bits"]).join(full.select(F.col("doc").alias("ydoc"), F.col("line").alias("yline"), F.col("bits").alias("ybits"), F.col("w").alias("yw")), ["ydoc", "yline", "ybits"])
    return both.where(9 * F.size(F.array_intersect("w", "yw")) >= 4 * (F.size("w") + F.size("yw"))).select("doc", "line", "bits").distinct()


def hot_words(flat: DataFrame) -> Callable[[Column], Column] | None:
    """A condition that holds for words of buckets far fuller than others, or None if there are none."""
    counts = dict(flat.groupBy(bucket(F.col("word"), FULL).alias("k")).count().collect())
    least = max(HOT_ROWS, HOT_TIMES * sum(counts.values()) / FULL)
    words = [0] * (FULL // 64)
    for k, n in counts.items():
        if n >= least:
            words[k // 64] |= 1 << k % 64
    if not any(words):
        return None
    full = F.from_json(F.lit("[" + ",".join(str(x - (1 << 64) if x >> 63 else x) for x in words) + "]"), "array<bigint>")
    shift_right = lambda x, n: F.call_function("shiftright", x, n)
    return lambda x: shift_right(F.get(full, shift_right(bucket(x, FULL), F.lit(6))), bucket(x, FULL).bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1


def before(x: str, y: str) -> Column:
    """Whether the place of y comes before that of x."""
    c = lambda side, name: F.col(f"{side}{name}")
    return (c(y, "doc") < c(x, "doc")) | ((c(y, "doc") == c(x, "doc")) & (c(y, "line") < c(x, "line")))


def pair(x: str, y: str) -> list[Column]:
    bits = lambda s: F.col(f"{s}rare").bitwiseXOR(F.col(f"{s}usual"))
    return [F.col(f"{x}doc").alias("doc"), F.col(f"{x}line").alias("line"), bits(x).alias("bits"), F.col(f"{y}doc").alias("ydoc"), F.col(f"{y}line").alias("yline"), bits(y).alias("ybits")]


def words_of(sets: DataFrame, count: Column, *more: str) -> DataFrame:
    """The first words of sets, and their positions."""
    return sets.select("doc", "line", "size", "rare", "usual", *more, F.posexplode(F.slice("prefix", F.lit(1), count)).alias("i", "word"))


def near_pairs(sets: DataFrame, hot) -> DataFrame:
    """Each set with the first and the last few before it, among those of about its size, along some words of its prefix."""
    # Those with the least hashes, as the rarest may be a variant's own. Positions do not count here.
    some = F.slice(F.sort_array(F.slice("prefix", F.lit(1), first_words(F.col("size")))), 1, FEW)
    few = sets.select("doc", "line", "size", "rare", "usual", F.lit(0).alias("i"), F.explode(some).alias("word"))
    salt = F.when(hot(F.col("word")), F.pmod(F.xxhash64("doc", "line"), F.lit(SALTS))).otherwise(0) if hot else F.lit(0)
    order = Window.partitionBy("word", F.floor(F.log(F.col("size")) / math.log(1.25)), salt).orderBy("doc", "line")
    row = F.struct("doc", "line", "size", "i", "rare", "usual")
    ys = F.array(*[F.lag(row, k).over(order) for k in range(1, NEAR + 1)], F.first(row).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # The first of its group has none before it.
    seen = few.withColumn("ys", ys).where(F.get("ys", F.lit(0)).isNotNull()).withColumn("y", F.explode("ys"))
    return seen.where(possible("", "y.") & before("", "y.")).select(*pair("", "y.")).distinct()


def band(size: Column) -> Column:
    """The band of a size: any order-preserving function will do, if sizes a quarter apart are in the same band or in neighbours."""
    return F.floor(F.log(2.5, size)).cast("int")


def all_pairs(sets: DataFrame, hot) -> DataFrame:
    """Undecided sets with all before them that the filters allow; decided ones come with their size negated.

    Rows meet by word and band of size; a set that may be similar to larger ones of the next band is in that one, too, with the
    words that it can share first with such ones.
    """
    size = F.abs("size")
    rows = sets.select("*", band(size).alias("own"), F.explode(F.sequence(band(size), band(F.floor(5 * size / 4)))).alias("band"))
    # The least size of a band, rounded down.
    edge = F.floor(F.pow(F.lit(2.5), "band") - 0.01)
    count = F.when(F.col("band") == F.col("own"), first_words(size)).otherwise(F.least(first_words(size), (F.floor((5 * size - 4 * edge) / 9) + 1).cast("int")))
    rows = words_of(rows.withColumn("count", count).where("count > 0"), F.col("count"), "band", "prefix")
    kept = ["doc", "line", "size", "i", "rare", "usual"]
    # One number as the key, since the sort of a join then needs no look at the rows.
    keyed = (rows.where(~hot(F.col("word"))) if hot else rows).select((F.col("word").cast("long") * 256 + F.col("band")).alias("key"), *kept)
    if hot:
        then = rows.where(hot(F.col("word"))).select("word", "band", F.explode(F.slice("prefix", F.col("i") + 2, F.size("prefix"))).alias("next"), *kept)
        keyed = keyed.unionByName(then.select(F.xxhash64("word", "band", "next").alias("key"), *kept))
    both = keyed.alias("u").join(keyed.alias("y"), (F.col("u.key") == F.col("y.key")) & possible("u.", "y.") & before("u.", "y."))
    return both.select(*pair("u.", "y.")).distinct()


def staying(docs: DataFrame) -> DataFrame:
    """(doc, stay): the numbers of the lines with words that stay, for each doc_id that has any."""
    spark = docs.sparkSession
    # Coding the words costs about as much as all the work on the texts; the sets have few values twice.
    lines = laid(hashed_lines(docs))
    sets = written(distinct_sets(lines), **{"parquet.enable.dictionary": "false"})
    release(spark)
    longer = sets.where("size > 3")  # of fewer words, only equal sets are similar
    hot = hot_words(words_of(longer, first_words(F.col("size"))))
    pairs = cut(near_pairs(longer, hot))
    release(spark)
    first = cut(verified(pairs, lines))
    dropped(lines)
    release(spark)
    # What the sieve lets through is undecided for certain.
    place = ["doc", "line", "bits"]
    known = sets.withColumn("bits", F.col("rare").bitwiseXOR(F.col("usual")))
    longer, held = known.where("size > 3"), sieve(first, *place)(*map(F.col, place))
    gone = longer.where(held).join(first.withColumn("gone", F.lit(True)), place, "left")
    pairs = cut(all_pairs(longer.where(~held).unionByName(gone.withColumn("size", F.when(F.col("gone"), -F.col("size")).otherwise(F.col("size"))).drop("gone")), hot))
    release(spark)
    # Few lines: from their texts, as the table would add to the disk in use.
    asked = sieve(pairs.select(F.explode(F.array("doc", "ydoc")).alias("doc")), "doc")
    second = cut(verified(pairs, hashed_lines(docs.where(asked(F.coalesce("doc_id", F.lit(LAST)))))))
    left = known.select(*place).join(first.unionByName(second), place, "left_anti")
    stay = written(left.groupBy("doc").agg(F.collect_set("line").alias("stay")))
    dropped(sets)
    release(spark)
    return stay


def deduped(docs: DataFrame) -> DataFrame:
    """docs (with doc_id and text) with their later matching lines taken out; n_lines and n_removed are added."""
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    rows = docs.select(F.struct(*[F.col(c) for c in [*names, "text"]]).alias("row"), F.coalesce("doc_id", F.lit(LAST)).alias("doc"))
    rows = rows.join(staying(docs.select("doc_id", "text")).hint("shuffle_hash"), "doc", "left").withColumn("lines", F.split("row.text", "\n", -1))
    # Most lines begin with a word, which a comparison of their first bytes tells.
    blank = F.filter(F.transform("lines", lambda x, i: F.when((x >= "!") | F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")), F.lit(-1)).otherwise(i)), lambda i: i >= 0)
    at = F.filter(F.sort_array(F.array_union(F.coalesce("stay", F.array().cast("array<int>")), blank)), lambda i: i < F.size("lines"))
    # Where as many lines with words stay as there are lines, none goes; a repeated doc_id may have more of them than this row.
    whole = F.size(F.coalesce("stay", F.array().cast("array<int>"))) == F.size("lines")
    rows = rows.withColumn("kept", F.when(F.col("row.text").isNotNull() & ~whole, at))
    out = F.when(F.col("kept").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n"))
    n = F.when(F.col("row.text").isNotNull(), F.size("lines")).otherwise(0)
    removed = F.when(F.col("kept").isNull(), 0).otherwise(n - F.size("kept"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in names], out.alias("text"), n.alias("n_lines"), removed.alias("n_removed"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents with deduplicated texts; n_chars, where there is one, follows the text."""
    rows = deduped(docs.drop("n_lines", "n_removed"))
    names = [F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return rows.select(*names)
