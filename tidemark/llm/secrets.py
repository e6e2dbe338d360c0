"""Secret scans in DataFrame functions alone: fixed patterns, and a battery of randomness tests.

Besides the base patterns, each run of 20 or more token characters is tested for being random in its inferred encoding (hexadecimal,
base 32 and base 36 in either case, base 62, base 64, base 64 for URLs; the smallest alphabet that has all its characters): a chi-squared test of a uniform alphabet, a runs test about the middle of the alphabet and a test of
serial correlation. The three p-values, under "uniformly random", combine by Bonferroni's rule. The Benjamini-Hochberg step, taken
over all documents and apart for each band of lengths, as short tokens carry less evidence, rejects tokens as ordinary text, so that at
most RATE of the dismissed ones are expected to be random. What is not dismissed is reported as kind `random`, unless a base span holds it.

Scale: nothing but a table of p-values' counts by length band and step (4 x 1,001 rows at most) is shuffled; every text is scanned
once, in about linear time, and the candidates of both steps are stored.

Defined results: a null text counts as empty; offsets are code points, end exclusive; a null doc_id is kept; repeated rows give repeated
results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: Pattern, group whose length counts, least length.
PATTERNS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    # Runs are maximal, so those that are too short can be passed over by the pattern itself.
    "hex": (r"(?<![0-9a-f])[0-9a-f]{16,}+", 0, 16),
}
# A value may follow "=" at once; the padding of the token before it is consumed with that token.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+=*+"
HEX, BASE32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
URL64 = BASE64[:62] + "-_"
BASE36, BASE62 = BASE64[:26] + BASE64[52:62], BASE64[:62]
#: Pattern and alphabet, from the smallest; what fits none is base 64.
ENCODINGS = (
    ("^(?:[0-9a-f]+|[0-9A-F]+)$", HEX),
    ("^[A-Z2-7]+$", BASE32),
    ("^[a-z2-7]+$", BASE32.lower()),
    ("^[A-Z0-9]+$", BASE36),
    ("^[a-z0-9]+$", BASE36.lower()),
    ("^[A-Za-z0-9]+$", BASE62),
    ("[-_]", URL64),
)
RATE = 0.05
BANDS = (32, 64, 128)
BLOCK = 256
STEP = 50  # steps of p for each power of ten


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """start, end and token of each leftmost, non-overlapping match, from the pieces between matches; `token` is that of the group.

    Places are summed up within blocks of BLOCK matches, then over the blocks, so that a list grows by copying only within its block.
    """
    whole, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    named = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(F.transform(whole, lambda x: F.length(x)).alias("size"), F.transform(parts, lambda x: F.length(x)).alias("gap"), named.alias("token"))
    none = F.array().cast("array<struct<start:int,end:int,token:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc, x):
        a = acc.at + x["gap"]
        return F.struct((a + x["size"]).alias("at"), F.concat(acc.out, F.array(F.struct(a.alias("start"), (a + x["size"]).alias("end"), x["token"].alias("token")))).alias("out"))

    def based(blocks):
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        bases = F.aggregate(blocks, zero, lambda acc, x: F.struct((acc.at + x["at"]).alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out")), lambda acc: acc.out)
        return F.flatten(F.zip_with(blocks, bases, lambda x, base: F.transform(x.out, lambda m: F.struct((m.start + base).alias("start"), (m.end + base).alias("end"), m.token.alias("token")))))

    # A lambda's body runs for each element, so what it needs is bound by a transform of one element.
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    in_blocks = lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(z), F.lit(1)) - 1) / BLOCK).cast("int")), lambda k: F.aggregate(F.slice(z, k * BLOCK + 1, BLOCK), start, step))
    found = once(once(F.filter(zipped, lambda x: x["size"].isNotNull()), in_blocks), based)
    return F.when(text.rlike(pattern), found).otherwise(none)


def tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by its logistic approximation (within 2e-4)."""
    z = F.least(F.greatest(z, F.lit(-15.0)), F.lit(15.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def encoding(token: Column) -> Column:
    out = F.lit(BASE64)
    for pattern, letters in reversed(ENCODINGS):
        out = F.when(token.rlike(pattern), F.lit(letters)).otherwise(out)
    return out


def tested(tokens: Column) -> Column:
    """start, end, n and p (combined) of an array of matches."""

    # A lambda's body runs for each element, so what it needs is computed by the transform before it.
    def coded(t):
        body = F.rtrim(F.translate(t.token, "=", " "))
        return F.struct(t.start.alias("start"), t.end.alias("end"), body.alias("body"), encoding(body).alias("letters"))

    def folded(t):
        body = F.when(t.letters == HEX, F.lower(t.body)).otherwise(t.body)
        return F.struct(t.start.alias("start"), t.end.alias("end"), body.alias("body"), t.letters.alias("letters"), F.length(body).cast("double").alias("n"), F.length(t.letters).cast("double").alias("k"))

    def indexed(t):
        index = F.transform(F.split(t.body, ""), lambda c: F.position(c, t.letters) - 1)
        return F.struct(t.start.alias("start"), t.end.alias("end"), t.body.alias("body"), t.letters.alias("letters"), t.n.alias("n"), t.k.alias("k"), index.alias("x"))

    def paired(t):
        pairs = F.arrays_zip(F.slice(t.x, 1, F.size(t.x) - 1).alias("a"), F.slice(t.x, 2, F.size(t.x)).alias("b"))
        return F.struct(t.start.alias("start"), t.end.alias("end"), t.body.alias("body"), t.letters.alias("letters"), t.n.alias("n"), t.k.alias("k"), t.x.alias("x"), pairs.alias("pairs"))

    def moments(t):
        n, k = t.n, t.k
        squares = F.aggregate(F.split(t.letters, ""), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(t.body, c, F.lit(""))), F.lit(2.0)))
        mean = F.aggregate(t.x, F.lit(0.0), lambda a, v: a + v) / n
        high = F.aggregate(t.x, F.lit(0.0), lambda a, v: a + F.when(v >= k / 2, 1.0).otherwise(0.0))
        changes = F.aggregate(t.pairs, F.lit(0.0), lambda a, p: a + F.when((p.a >= k / 2) != (p.b >= k / 2), 1.0).otherwise(0.0))
        return F.struct(t.start.alias("start"), t.end.alias("end"), n.alias("n"), k.alias("k"), squares.alias("squares"), mean.alias("mean"), high.alias("high"), changes.alias("changes"), t.x.alias("x"), t.pairs.alias("pairs"))

    def p_values(t):
        n, k = t.n, t.k
        chi = (k / n * t.squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        expected = 2 * t.high * (n - t.high) / n + 1
        spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
        runs = F.abs(t.changes + 1 - expected) / spread
        total = F.aggregate(t.x, F.lit(0.0), lambda a, v: a + (v - t.mean) * (v - t.mean))
        lag = F.aggregate(t.pairs, F.lit(0.0), lambda a, p: a + (p.a - t.mean) * (p.b - t.mean))
        serial = F.when(total > 0, F.abs(lag / F.greatest(total, F.lit(1e-9)) + 1 / n) * F.sqrt(n)).otherwise(15.0)
        p = F.least(F.lit(1.0), 3 * F.least(tail(chi), 2 * tail(runs), 2 * tail(serial)))
        return F.struct(t.start.alias("start"), t.end.alias("end"), n.cast("int").alias("n"), F.greatest(p, F.lit(1e-20)).alias("p"))

    for stage in (coded, folded, indexed, paired, moments, p_values):
        tokens = F.transform(tokens, stage)
    return tokens


def band(n: Column) -> Column:
    out = F.lit(len(BANDS))
    for k, most in reversed(list(enumerate(BANDS))):
        out = F.when(n < most, k).otherwise(out)
    return out


def step_of(p: Column) -> Column:
    return F.floor(-F.log10(p) * STEP).cast("int")


def cuts(candidates: DataFrame, rate: float = RATE) -> dict[int, int]:
    """By length band, the step from which on tokens are dismissed: the Benjamini-Hochberg rule, p rounded up to whole steps."""
    counts = candidates.select(F.explode("tokens").alias("t")).groupBy(band(F.col("t.n")).alias("band"), step_of(F.col("t.p")).alias("step")).count()
    w = Window.partitionBy("band")
    ranked = counts.select("band", "step", F.sum("count").over(w).alias("all"), F.sum("count").over(w.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)).alias("at_most"))
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("step") / STEP) <= rate * F.col("at_most") / F.col("all"))
    return {r[0]: r[1] for r in passed.groupBy("band").agg(F.min("step")).collect()}  # a row for each band


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind> and base_sha256 of the base spans, spans (all) and n_random of every row of docs(doc_id, text)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    long_enough = lambda least: lambda m: F.length(m.token) >= least
    base = {k: F.filter(matches(F.col("text"), p, g), long_enough(least)) for k, (p, g, least) in PATTERNS.items()}
    found = own.select("doc_id", *(v.alias(k) for k, v in base.items()), F.when(F.col("text").rlike(TOKEN), tested(matches(F.col("text"), TOKEN))).otherwise(F.array()).alias("tokens"))
    found = stored(found, "candidates")
    dismissed = cuts(found)
    kinds = list(PATTERNS)
    one = lambda k: F.transform(F.col(k), lambda m: F.struct(m.start.alias("start"), F.lit((kinds + ["random"]).index(k)).alias("rank"), m.end.alias("end"), F.lit(k).alias("kind")))
    based = found.withColumn("base", F.concat(*map(one, kinds)))

    def kept(t):
        rule = F.lit(True)
        for b, s in dismissed.items():
            rule = rule & ~((band(t.n) == b) & (step_of(t.p) >= s))
        return rule & ~F.exists(F.col("base"), lambda m: (m.start <= t.start) & (t.end <= m.end))

    based = based.withColumn("random", F.filter("tokens", kept))
    written = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda m: F.concat_ws(":", m.kind, m.start, m.end)), ",")
    return based.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in kinds), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.concat("base", one("random"))).alias("spans"), F.size("random").cast("long").alias("n_random"))
