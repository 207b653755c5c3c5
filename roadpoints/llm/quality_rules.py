"""Quality rules: base statistics of every text, and robust outliers among the texts of a language and source.

Outliers are found by minimum-covariance-determinant (MCD) estimates of transformed statistics: mean and covariance of
the three quarters of a group that lie closest together, reached by concentration steps from coordinate-wise medians.
Only DataFrame functions are used. Statistics are rounded to whole units before they are summed, so sums are exact and
do not depend on the order of rows or partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from roadpoints.llm.registry import query, table
from roadpoints.session import cut

#: base rules: fewest words; largest share (per cent) of words in repeated three-word windows
MIN_WORDS, MAX_REPEAT = 50, 50
#: groups of fewer documents are judged together: the small sources of a language, and if those are few, all small ones
MIN_GROUP = 60
#: share of a group that the estimate rests on; concentration steps
KEEP_NUM, KEEP_DEN, STEPS = 3, 4, 3
#: squared Mahalanobis distance from which a document is rejected; 20.5 is the 99.9 per cent point of chi-squared with 5 degrees,
#: the rest is room for tails that are heavier than normal ones
CUTOFF = 36.0
#: median of chi-squared with 5 degrees of freedom, to which the distances of a group are scaled
MEDIAN = 4.351460191095531
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "#*$%&|<>"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: shares into which the documents of one language and source are dealt for joins
SHARES = 32
#: units of a feature; smallest standard deviation assumed, in units (regularises groups without spread)
UNIT, FLOOR = 256, 12.0
P = 5
XS = [f"x{i}" for i in range(P)]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper of every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
                    F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), text.alias("t"))
    d = d.select("doc_id", "lang", "source", "t", F.filter(F.split("t", SPACE), lambda w: w != "").alias("words"),
                 F.filter(F.split("t", "\n"), lambda x: F.trim(F.translate(x, SPACES, " ")) != "").alias("lines"))
    # a key has 33 bits of the window's hash and its position: repeated windows are neighbours in the sorted keys
    keys = F.expr("transform(words, (w, i) -> shiftleft(xxhash64(w, get(words, i + 1), get(words, i + 2)), 31) + i)")
    length = lambda c: F.length(c).cast("long")
    d = d.select("doc_id", "lang", "source", "words", F.size("words").cast("long").alias("n_words"), length(F.translate("t", SPACES, "")).alias("word_chars"),
                 (length("t") - length(F.translate("t", SYMBOLS, ""))).alias("n_symbols"), (length("t") - length(F.translate("t", UPPER, ""))).alias("n_upper"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.when(F.size("words") >= 3, F.sort_array(F.slice(keys, 1, F.greatest(F.size("words") - 2, F.lit(0))))).alias("keys"))
    near = F.expr("filter(keys, (k, j) -> shiftright(k, 31) = shiftright(get(keys, j - 1), 31) or shiftright(k, 31) = shiftright(get(keys, j + 1), 31))")
    rest = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_upper"]
    d = d.select(*rest, "words", near.alias("near"))
    # equal 33 bits are not equal windows: the candidates are compared by their words
    window = F.expr("""transform(near, k -> named_struct('a', get(words, int(k & 2147483647L)), 'b', get(words, int((k & 2147483647L) + 1)),
                       'c', get(words, int((k & 2147483647L) + 2)), 'p', int(k & 2147483647L)))""")
    d = d.select(*rest, F.when(F.size("near") > 0, F.sort_array(window)).alias("s"))
    same = lambda j: f"(s_.a = get(s, {j}).a and s_.b = get(s, {j}).b and s_.c = get(s, {j}).c)"
    d = d.select(*rest, F.expr(f"sort_array(transform(filter(s, (s_, j) -> {same('j - 1')} or {same('j + 1')}), s_ -> s_.p))").alias("p"))
    n = F.expr("aggregate(transform(p, (v, j) -> least(3, coalesce(get(p, j + 1) - v, 3))), 0, (a, v) -> a + v)")
    return d.select(*rest, F.coalesce(n, F.lit(0)).cast("long").alias("n_repeat_words"))


def _features(s: DataFrame) -> DataFrame:
    """Whole-number features of documents with words: logarithms of the mean word length, of symbols, capitals and repeats."""
    share = lambda c: F.round(UNIT * F.log(1 + F.col(c) / F.col("n_words")))
    return s.withColumns({"x0": share("word_chars"), "x1": share("n_symbols"), "x2": share("n_upper"), "x3": share("n_dup_lines"), "x4": share("n_repeat_words")})


def _quantile(counts: DataFrame, keys: list[str], value: str, num: int, den: int) -> DataFrame:
    """keys and q: the smallest value that num / den of a key's rows do not exceed, of ``counts`` (keys, value, n). Values are whole numbers of a
    bounded range, so a key has a bounded number of them."""
    w = Window.partitionBy(*keys)
    counts = counts.withColumns({"c": F.sum("n").over(w.orderBy(value)), "all": F.sum("n").over(w)})
    return counts.where(F.col("c") * den >= F.col("all") * num).groupBy(*keys).agg(F.min(value).alias("q"))


def _beside(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` (with doc_id) joined with a row for each key; the rows of a key are dealt into SHARES, as one key may have a third of them."""
    dealt = df.withColumn("_share", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)))
    return dealt.join(small.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)).cast("array<long>"))), [*keys, "_share"]).drop("_share")


def _group(df: DataFrame) -> DataFrame:
    """``df`` with its group (g_lang, g_source); see MIN_GROUP."""
    own = df.groupBy("lang", "source").agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang", F.col("n") >= MIN_GROUP)
    own = own.withColumn("m", F.sum("n").over(w))  # of the small sources of the language
    own = own.select("lang", "source", F.when((F.col("n") >= MIN_GROUP) | (F.col("m") >= MIN_GROUP), F.col("lang")).otherwise("*").alias("g_lang"),
                     F.when(F.col("n") >= MIN_GROUP, F.col("source")).otherwise("*").alias("g_source"))
    return _beside(df, own, ["lang", "source"])


G = ["g_lang", "g_source"]


def _marginals(df: DataFrame) -> DataFrame:
    """(group, i, v, n): how many documents of a group have the value v of feature i, from one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(x).alias("v")) for i, x in enumerate(XS)]))
    return df.select(*G, each.alias("f")).groupBy(*G, "f.i", "f.v").agg(F.count("*").alias("n"))


def _whitened(m: DataFrame) -> DataFrame:
    """The rows (group, m0.., c00..) as (group, m0.., w00..): w is the inverse of the Cholesky factor of c."""
    def step(df, **cols):
        return df.withColumns(cols)
    for j in range(P):
        m = step(m, **{f"l{j}{j}": F.sqrt(_sum(F.col(f"c{j}{j}"), [-F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)]))})
        m = step(m, **{f"l{i}{j}": _sum(F.col(f"c{i}{j}"), [-F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)]) / F.col(f"l{j}{j}") for i in range(j + 1, P)})
    for j in range(P):
        m = step(m, **{f"w{j}{j}": 1 / F.col(f"l{j}{j}")})
        for i in range(j + 1, P):
            m = step(m, **{f"w{i}{j}": -_sum(F.lit(0.0), [F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)]) / F.col(f"l{i}{i}")})
    return m.select(*G, *[f"m{i}" for i in range(P)], *[f"w{i}{j}" for i in range(P) for j in range(i + 1)])


def _sum(first: Column, rest: list[Column]) -> Column:
    for c in rest:
        first = first + c
    return first


def _distance(df: DataFrame, est: DataFrame) -> DataFrame:
    """``df`` with d2, the squared Mahalanobis distance under its group's estimate, and its bin q (64 to a factor of e)."""
    z = [_sum(F.lit(0.0), [F.col(f"w{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(i + 1)]) for i in range(P)]
    out = _beside(df, est, G)
    out = out.withColumn("d2", _sum(F.lit(0.0), [F.pow(c, F.lit(2.0)) for c in z]))
    kept = ["scale"] if "scale" in est.columns else []
    return out.select(*df.columns, *kept, "d2", F.floor(64 * F.log(1 + F.col("d2"))).alias("q"))


def estimates(df: DataFrame) -> DataFrame:
    """The MCD estimate of every group of ``df`` (g_lang, g_source, x0..x4), as _whitened() gives it, and ``scale``, which brings the
    median of a group's squared distances to MEDIAN."""
    counts = cut(_marginals(df))  # small from here to the start
    mid = _quantile(counts, [*G, "i"], "v", 1, 2).withColumnRenamed("q", "mid")
    dev = counts.join(mid, [*G, "i"]).groupBy(*G, "i", "mid", F.abs(F.col("v") - F.col("mid")).alias("v")).agg(F.sum("n").alias("n"))
    both = _quantile(dev, [*G, "i", "mid"], "v", 1, 2).withColumnRenamed("q", "mad")
    start = both.groupBy(*G).agg(*[F.max(F.when(F.col("i") == i, F.col("mid"))).alias(f"m{i}") for i in range(P)],
                                 *[F.max(F.when(F.col("i") == i, F.pow(1.4826 * F.col("mad"), F.lit(2.0)) + FLOOR * FLOOR)).alias(f"c{i}{i}") for i in range(P)])
    start = start.withColumns({f"c{i}{j}": F.lit(0.0) for i in range(P) for j in range(i)})
    est = cut(_whitened(start))
    parts = [f"s{i}" for i in range(P)] + [f"p{i}{j}" for i in range(P) for j in range(i + 1)]
    w = Window.partitionBy(*G)
    for _ in range(STEPS):
        # sums of each bin of distances; the core is the bins up to the one in which its share of the group is reached
        bins = _distance(df, est).groupBy(*G, "q").agg(F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(XS)],
                                                       *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i in range(P) for j in range(i + 1)])
        bins = bins.withColumns({"before": F.coalesce(F.sum("n").over(w.orderBy("q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all": F.sum("n").over(w)})
        core = bins.where(F.col("before") * KEEP_DEN < F.col("all") * KEEP_NUM)
        sums = core.groupBy(*G).agg(F.sum("n").cast("double").alias("n"), *[F.sum(c).alias(c) for c in parts])
        sums = sums.select(*G, "n", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(P)], *[f"p{i}{j}" for i in range(P) for j in range(i + 1)])
        cov = lambda i, j: F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") + (FLOOR * FLOOR if i == j else 0.0)
        est = cut(_whitened(sums.select(*G, *[f"m{i}" for i in range(P)], *[cov(i, j).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)])))
    half = _quantile(_distance(df, est).groupBy(*G, "q").agg(F.count("*").alias("n")), G, "q", 1, 2)
    return cut(est.join(half.select(*G, F.greatest((F.exp((F.col("q") + 1) / 64) - 1) / MEDIAN, F.lit(1.0)).alias("scale")), G))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept of ``docs`` (doc_id, text,
    lang, source; other columns are ignored), one row per row.

    Base rules: fewer than 50 words, or more than half of the words in repeated three-word windows. Documents that pass them are
    kept unless their distance from the MCD estimate of their language and source reaches CUTOFF. A null or empty text fails the
    base rules; a null language or source is a value of its own; base failures have no distance.
    """
    s = cut(statistics(docs).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))))
    good = _features(s.where("not base_failed"))
    good = cut(_group(good))  # every step reads it
    est = estimates(good.select("doc_id", *G, *XS))
    judged = _distance(good, est).drop("q")
    judged = judged.withColumn("distance", F.col("d2") / F.col("scale"))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    failed = s.where("base_failed").select(*cols, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return judged.select(*cols, "distance", (F.col("distance") < CUTOFF).alias("kept")).unionByName(failed)


@query("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
