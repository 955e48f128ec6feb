"""Quality rules whose cutoffs carry a guarantee on wrongly rejected documents.

Every text gets exact counts (words, symbols, repeated lines, repeated three-word windows, capitals).
Five ratios of these may reject a document above a cutoff. Candidate cutoffs form a fixed grid. In each
stratum (the document's language) the labelled documents are dealt into two halves by a digest of their id:

* The first half chooses. Each rule takes the cutoff that rejects the most labelled bad documents less good
  ones (of equal ones the most lenient), if that is above zero. Rules are ordered: fewest good documents
  rejected first, then the largest difference.
* The second half, the holdout, certifies. The union of the first j rules passes when the exact binomial
  tail P(Binomial(good documents, RISK) <= good documents it rejects) is at most DELTA over the number of
  labelled strata. Unions are tested in the order fixed before, up to the first that fails, so the tests
  within a stratum need no further correction, and the division covers the strata.

With probability 1 - DELTA, all certified rules of a stratum together reject at most RISK of its good
documents that pass the base rule, in every stratum. A stratum needs about 90 good documents in its holdout
before anything can be certified (more with more strata). A stratum without a certificate, and one without
labels, rejects nothing beyond the base rule.

Native throughout: windows are sorted inside their row, the binomial tail is a fold over an array, and
the certified cutoffs are one narrow row a stratum, joined under a salt, so a hot stratum is split. Every
text is measured once.

Defined cases: a null or blank text has no words, all counts zero, and fails the base rule; repeated rows
repeat; a null stratum is the stratum of no name, with labels of its own; labels of unknown documents and
null labels are ignored; a document with several labels counts as good when at least half of them say so;
an empty table gives an empty result; other columns of the input are kept by `keep_good` and ignored by `judge`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm._shared import WORD_SPACE, count_chars, join_salted, lines_of, materialise, settled, spare_name, table, ticked, words_of

SYMBOLS = "#*$%&|<>"
CAPITALS = "A-Z"
MIN_WORDS = 50
#: Largest share of a stratum's good documents that all its rules together may reject, and the chance to miss it.
RISK = 0.05
DELTA = 0.05
GRID: dict[str, list[float]] = {
    "symbols": [0.02, 0.05, 0.1, 0.2, 0.5, 1.0],
    "dup_lines": [0.05, 0.1, 0.2, 0.3, 0.5],
    "repeats": [0.1, 0.15, 0.2, 0.3, 0.4],
    "capitals": [0.1, 0.2, 0.3, 0.5, 0.7],
    "word_length": [7.0, 8.0, 9.0, 10.0, 12.0],
}
RULES = list(GRID)


def with_sorted_windows(df: DataFrame, words: str, out: str, width: int = 3) -> DataFrame:
    """df with `out`: the sorted (window, start) pairs of the array column `words`; empty where none repeats.

    Equal windows have equal hashes, so without equal hashes nothing repeats. Every array is a column of
    its own: inside a lambda an expression would be worked out anew for each element.
    """
    w, n, hashes = ticked(words), F.size(ticked(words)), spare_name(df, out + "_hashes")
    starts = F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))
    hashed = df.withColumn(hashes, F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])))
    clean = F.size(F.array_distinct(ticked(hashes))) == F.size(ticked(hashes))
    places = F.when(clean, F.array().cast("array<int>")).otherwise(starts)
    windows = F.transform(places, lambda i: F.struct(F.concat_ws(" ", *[F.get(w, i + k) for k in range(width)]).alias("w"), i.alias("i")))
    return hashed.withColumn(out, F.sort_array(windows)).drop(hashes)


def covered_words(windows: Column, width: int = 3) -> Column:
    """How many words lie in windows that occur twice or more; windows are sorted (window, start) pairs."""
    same = lambda x, j, step: F.coalesce(F.get(windows, j + step)["w"] == x["w"], F.lit(False))
    twice = F.filter(windows, lambda x, j: same(x, j, -1) | same(x, j, 1))
    return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(*[x["i"] + k for k in range(width)])))))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct column of the counts added; its name is the last of the result."""
    words, lines, windows, out = (spare_name(docs, x) for x in ("q_words", "q_lines", "q_windows", "q_counts"))
    text = F.coalesce(ticked(text_col).cast("string"), F.lit(""))
    split = docs.withColumn(words, words_of(text)).withColumn(lines, lines_of(text))
    counts = F.struct(
        F.size(ticked(words)).cast("long").alias("n_words"),
        (F.length(text) - count_chars(text, WORD_SPACE)).cast("long").alias("word_chars"),
        count_chars(text, SYMBOLS).alias("n_symbols"),
        (F.size(ticked(lines)) - F.size(F.array_distinct(ticked(lines)))).cast("long").alias("n_dup_lines"),
        covered_words(ticked(windows)).cast("long").alias("n_repeat_words"),
        F.size(ticked(lines)).cast("long").alias("n_lines"),
        count_chars(text, CAPITALS).alias("n_capitals"),
    )
    return with_sorted_windows(split, words, windows).withColumn(out, settled(counts)).drop(words, lines, windows)


def base_failed(c: Column) -> Column:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def ratios(c: Column) -> Column:
    """What each of RULES compares with its cutoff, as an array in their order."""
    per = lambda a, b: F.when(c[b] > 0, c[a].cast("double") / c[b].cast("double")).otherwise(F.lit(0.0))
    values = {
        "symbols": per("n_symbols", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"),
        "capitals": per("n_capitals", "word_chars"),
        "word_length": per("word_chars", "n_words"),
    }
    return F.array(*[values[r] for r in RULES])


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) for k <= n * p, as a fold over 1..k; 1.0 where k is larger."""
    import math

    odds = p / (1 - p)
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    start = F.struct((n.cast("double") * math.log1p(-p)).alias("log"), F.lit(1.0).alias("sum"))

    def step(acc, i):
        ratio = (n - i + 1).cast("double") / i.cast("double") * odds
        return F.struct((acc["log"] + F.log(ratio)).alias("log"), (acc["sum"] / ratio + 1.0).alias("sum"))

    tail = F.aggregate(steps, start, step, lambda a: F.exp(a["log"] + F.log(a["sum"])))
    return F.when(k.cast("double") > n.cast("double") * p, F.lit(1.0)).otherwise(tail)


def first_hit(values: Column, limits: Column) -> Column:
    """Place, from 1, of the first of limits (rule, cutoff) that values exceed; 0 if none."""
    return F.array_position(F.transform(limits, lambda x: F.get(values, x["rule"]) > x["cutoff"]), True)


def chosen_rules(rows: DataFrame) -> DataFrame:
    """(stratum, limits): the rules worth having by (stratum, good, v), most harmless first, one cutoff a rule."""
    cases = [F.struct(F.lit(k).alias("rule"), F.lit(c).alias("cutoff"), (F.get("v", F.lit(k)) > c).alias("hit")) for k, r in enumerate(RULES) for c in GRID[r]]
    hit = lambda good: F.count_if((F.col("good") if good else ~F.col("good")) & F.col("x.hit"))
    tried = rows.select("stratum", "good", F.explode(F.array(*cases)).alias("x")).groupBy("stratum", "x.rule", "x.cutoff").agg(hit(True).alias("k"), hit(False).alias("caught"))
    best = tried.where("caught > k").groupBy("stratum", "rule").agg(F.max(F.struct((F.col("caught") - F.col("k")).alias("net"), "cutoff", "k")).alias("b"))
    order = F.sort_array(F.collect_list(F.struct(F.col("b.k").alias("k"), (-F.col("b.net")).alias("less"), "rule", F.col("b.cutoff").alias("cutoff"))))
    return best.groupBy("stratum").agg(F.transform(order, lambda x: F.struct(x["rule"].alias("rule"), x["cutoff"].alias("cutoff"))).alias("limits"))


def calibrate(labelled: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, limits, n, k) from labelled (id, stratum, good, counts): the certified cutoffs of each stratum that has any.

    limits are (rule, cutoff) with rules by number; n good documents of the holdout, of which k[j] meet one
    of the first j + 1 rules. Rows that fail the base rule must be left out before: it is not the method's to certify.
    """
    rows = labelled.select("stratum", "good", ratios(F.col("counts")).alias("v"), (F.md5(F.col("id").cast("string").cast("binary")) < "8").alias("choosing"))
    chosen = chosen_rules(rows.where("choosing"))
    held = join_salted(rows.where(~F.col("choosing") & F.col("good")), chosen, "stratum", "inner").withColumn("at", first_hit(F.col("v"), F.col("limits")))
    places = range(1, len(RULES) + 1)
    counted = held.groupBy("stratum", "limits").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.count_if((F.col("at") > 0) & (F.col("at") <= j)) for j in places]).alias("k"))
    most = delta / max(labelled.select("stratum").distinct().count(), 1)
    passed = F.array(*[(F.size("limits") >= j) & (binomial_tail(F.col("n"), F.get("k", F.lit(j - 1)), risk) <= most) for j in places], F.lit(False))
    certified = F.slice("limits", F.lit(1), (F.array_position(passed, False) - 1).cast("int"))
    return counted.select("stratum", certified.alias("limits"), "n", "k").where(F.size("limits") > 0)


def strata_of(docs: DataFrame, stratum_col: str | None) -> Column:
    return F.coalesce(ticked(stratum_col).cast("string"), F.lit("")) if stratum_col and stratum_col in docs.columns else F.lit("")


def fit_cutoffs(measured: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """The written table (stratum, limits) of certified cutoffs, from measured (id, stratum, counts) and labels (id, label)."""
    good = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).alias("good"))
    labelled = materialise(measured.where(~base_failed(F.col("counts"))).join(good, "id").select("id", "stratum", "good", "counts"), "labelled")
    return materialise(calibrate(labelled).select("stratum", "limits"), "cutoffs")


def verdict(counts: Column, limits: Column) -> Column:
    """kept: false where the base rule fails or a ratio is above a certified cutoff of the row's own stratum; null limits reject nothing."""
    return ~(base_failed(counts) | (F.coalesce(first_hit(ratios(counts), limits), F.lit(0)) > 0))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", label_col: str = "quality") -> DataFrame:
    """(id, stratum, counts, base_failed, kept) for every row of docs."""
    measured = measures(docs.select(ticked(id_col).alias("id"), strata_of(docs, stratum_col).alias("stratum"), ticked(text_col).alias("text")), "text")
    measured = materialise(measured.select("id", "stratum", F.col("q_counts").alias("counts")), "measures")
    found = join_salted(measured, fit_cutoffs(measured, labels, id_col, label_col), "stratum")
    return found.select("id", "stratum", "counts", base_failed(F.col("counts")).alias("base_failed"), verdict(F.col("counts"), F.col("limits")).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", label_col: str = "quality") -> DataFrame:
    """The rows of docs that the rules keep, columns unchanged.

    Rows are written once with their counts; fitting reads the counts alone, and the verdict filters the written rows.
    """
    measured = measures(docs, text_col)
    counts, stratum, limits = measured.columns[-1], spare_name(measured, "q_stratum"), spare_name(measured, "q_limits")
    measured = materialise(measured.withColumn(stratum, strata_of(docs, stratum_col)), "measured-rows")
    narrow = measured.select(ticked(id_col).alias("id"), ticked(stratum).alias("stratum"), ticked(counts).alias("counts"))
    cutoffs = fit_cutoffs(narrow, labels, id_col, label_col).select(F.col("stratum").alias(stratum), F.col("limits").alias(limits))
    return join_salted(measured, cutoffs, stratum).where(verdict(ticked(counts), ticked(limits))).select(*[ticked(c) for c in docs.columns])


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        F.col("id").alias("doc_id"),
        *[F.col("counts")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed",
        "kept",
    )
