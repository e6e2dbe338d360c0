"""I-Match document fingerprints, in DataFrame functions alone.

Terms are lower-case runs of letters and digits. The lexicon keeps terms within a band of inverse document frequency, counted over all
documents; it is dealt at random into SUBSETS subsets. Each subset gives one hash: that of the sorted distinct terms which a text has in
it. Two fingerprints are as alike as the share of subsets, of those in which either text has a term, with the same hash.

Scale: document frequencies are those of 64-bit term hashes, counted map side first. A term of the lexicon is in a share of at least
exp(-band[1]) of the documents, so the lexicon has at most exp(band[1]) = 2,000 times as many terms as a document has distinct terms on
average, whatever the corpus; it goes to the tasks as a constant that is looked up exactly. A text's terms are sorted once, by subset and term, and folded once.

A text's edited form takes the second half from the next document by ascending doc_id. Documents are dealt by ranges of doc_id, cut at
quantiles of a sample; the first document of each range is sent to the range before it too, so texts are shuffled once and no task sees all of them.
There are RANGES ranges at most (at 100 TB 1.5 GB of text each, which Spark sorts with spilling); their number never changes a result.

Defined results: a null text counts as empty; a text without a term in the lexicon has an all-zero fingerprint, and two of these are
alike by 1; null doc_ids come first in the order, rows with equal doc_ids are ordered by text; a single document follows itself; an
empty table gives no rows; other columns are ignored; very long texts are taken whole. Rows of one doc_id, or without one, are one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUBSETS = 64
BAND = (3.0, 7.6)
RANGES = 1 << 16
RANGE_ROWS = 2000
#: Sampled ids for each range of doc_ids.
EACH = 20


def terms(text: Column) -> Column:
    """Distinct terms as hashes."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> list[int]:
    """The hashes of terms whose inverse document frequency, ln(documents / df), lies in the band and whose df is 2 or more."""
    n = max(1, docs.count())
    df = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").count()
    idf = F.log(F.lit(float(n)) / F.col("count"))
    return [r[0] for r in df.where((F.col("count") >= 2) & idf.between(*band)).select("term").collect()]


def numbers(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")  # a constant once planned


def in_lexicon(known: list[int]):
    """A function that tells whether a hash is one of `known`.

    A table of bits, a sixteenth of them set, turns most others away; then the hash is looked for, as text, in its place of a table that holds all
    of them. Each table stands once in the expression.
    """
    bits = 1 << max(10, (16 * len(known)).bit_length())
    places = 1 << max(4, len(known).bit_length())
    words, held = [0] * (bits // 64), [""] * places
    for t in known:
        words[(t & (bits - 1)) >> 6] |= 1 << (t & 63)
        k = (t >> 20) & (places - 1)
        held[k] = f"{held[k] or ','}{t},"
    word_column = numbers([w - (1 << 64) if w >> 63 else w for w in words])
    held_column = F.split(F.lit(";".join(held)), ";")

    def found(t: Column) -> Column:
        on = F.getbit(F.element_at(word_column, F.shiftright(t.bitwiseAND(F.lit(bits - 1)), 6).cast("int") + 1), t.bitwiseAND(F.lit(63)).cast("int")) == 1
        place = F.shiftright(t, 20).bitwiseAND(F.lit(places - 1)).cast("int") + 1
        return on & F.contains(F.element_at(held_column, place), F.concat(F.lit(","), t.cast("string"), F.lit(",")))

    return found


def fingerprint(text: Column, known: list[int]) -> Column:
    """SUBSETS hashes from 1 to 65535; 0 where the text has no term in the subset. A term's subset is given by its upper bits, so that sorted terms are grouped."""
    ordered = F.array_sort(F.filter(terms(text), in_lexicon(known)))
    subset = lambda t: (F.shiftright(t, 58) + SUBSETS // 2).cast("int")
    short = lambda h: F.pmod(h, F.lit(65535)).cast("int") + 1
    gap = lambda a, b: F.array_repeat(F.lit(0), b - a - 1)
    start = F.struct(F.lit(-1).alias("k"), F.lit(0).cast("long").alias("h"), F.array().cast("array<int>").alias("out"))
    closed = lambda acc, k: F.when(acc.k < 0, gap(acc.k, k)).otherwise(F.concat(acc.out, F.array(short(acc.h)), gap(acc.k, k)))

    def step(acc, t):
        same = F.struct(acc.k.alias("k"), F.xxhash64(acc.h, t).alias("h"), acc.out.alias("out"))
        other = F.struct(subset(t).alias("k"), F.xxhash64(F.lit(0).cast("long"), t).alias("h"), closed(acc, subset(t)).alias("out"))
        return F.when(acc.k == subset(t), same).otherwise(other)

    return F.aggregate(ordered, start, step, lambda acc: closed(acc, F.lit(SUBSETS)))


def likeness(a: Column, b: Column) -> Column:
    used = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x > 0) | (y > 0)), lambda z: z))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x > 0) & (x == y)), lambda z: z))
    return F.when(used == 0, 1.0).otherwise(same / used)


def written(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))), "")


def range_of(value: Column, cuts: list[int]) -> Column:
    """The number of cuts, which ascend, that are not above the value: a binary search."""
    if not cuts:
        return F.lit(0)
    held, halves = numbers(cuts), [1 << k for k in reversed(range(len(cuts).bit_length()))]
    step = lambda at, h: F.when((at + h <= len(cuts)) & (F.element_at(held, F.least(at + h, F.lit(len(cuts)))) <= value), at + h).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), step)


def range_cuts(docs: DataFrame, n: int, parts: int) -> list[int]:
    """About parts - 1 doc_ids that divide the rows evenly, from a sample of some EACH * parts distinct ids by hash; they only balance the work."""
    if parts == 1:
        return []
    chance = min(1.0, EACH * parts / n)
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < chance * (1 << 40))).distinct()
    known = sorted(ids.toArrow().column(0).to_pylist())
    return sorted({known[len(known) * k // parts] for k in range(1, parts)}) if known else []


def with_next(docs: DataFrame, made, columns: list[str], ranges: int = RANGES, rows: int = RANGE_ROWS) -> DataFrame:
    """made(docs), for docs(doc_id, text), with next_<column> of the document that follows by doc_id; the first follows the last."""
    n = docs.count()
    parts = max(1, min(ranges, -(-n // rows)))
    cuts = range_cuts(docs, n, parts)
    dealt = docs.withColumn("range", F.when(F.col("doc_id").isNull(), 0).otherwise(range_of(F.col("doc_id"), cuts)))
    null_first = dealt.where("doc_id is null").limit(1).count()
    firsts = [(r[0], r[1]) for r in dealt.groupBy("range").agg(F.min("doc_id")).orderBy("range").collect()]
    if null_first:
        firsts[0] = (firsts[0][0], None)
    targets = [(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]  # the range before it; the last for the first
    spark = docs.sparkSession
    sent = F.broadcast(spark.createDataFrame(targets, "first long, target int"))  # a row for each range
    ghosts = dealt.join(sent, F.col("doc_id").eqNullSafe(F.col("first")))
    pick = Window.partitionBy("target").orderBy("text")
    ghosts = ghosts.withColumn("rank", F.row_number().over(pick)).where("rank = 1").withColumn("range", F.col("target")).select(*dealt.columns, F.lit(1).alias("ghost"))
    both = made(dealt.withColumn("ghost", F.lit(0)).unionByName(ghosts))
    w = Window.partitionBy("range").orderBy("ghost", F.asc_nulls_first("doc_id"), "text")
    return both.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns)).where("ghost = 0").drop("ghost", "range")


def fingerprints(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row of docs(doc_id, text)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = lexicon(own, band)
    near = with_next(own, lambda df: df.withColumn("fp", fingerprint(F.col("text"), known)), ["text", "fp"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = near.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", F.concat(F.left("text", n - half), F.left("next_text", half)).alias("edited"))
    done = edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fp", "next_fp", fingerprint(F.col("edited"), known).alias("edited_fp"))
    return done.select("doc_id", "n_chars", "edited_sha256", written(F.col("fp")).alias("fingerprint"), written(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
