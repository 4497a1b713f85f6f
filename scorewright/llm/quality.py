"""Quality rules: word counts, and a log-likelihood ratio of hashed n-grams."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm.common import BLANKS, fenced, maybe_among, words, written

BUCKETS = 10_000
# Weight of the prior, in n-grams.
PRIOR = 10_000.0
# Cells that the scores of labelled rows are counted in, to find the threshold.
SCORE_CELLS = 1_024
# Of the trusted keys, those with this remainder set the threshold instead of the target.
FOLDS = 4
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
# Fixed value: the characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 3
RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _hashes(w: Column) -> Column:
    """A hash for each window of three words."""
    last = F.size(w) - WINDOW
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))


def _covered(pairs: Column) -> Column:
    """Words in windows whose hash occurs again; ``pairs`` are (hash, start) in order."""
    again = F.filter(
        F.transform(
            pairs,
            lambda p, i: F.when(
                (F.get(pairs, i + 1)["h"] == p["h"])
                | ((i > 0) & (F.get(pairs, F.greatest(i - 1, F.lit(0)))["h"] == p["h"])),
                p["at"],
            ),
        ),
        lambda at: at.isNotNull(),
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        F.sort_array(again),
        start,
        lambda acc, at: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("n"), at.alias("last")
        ),
        lambda acc: acc["n"].cast("long"),
    )


def with_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and ``_words``."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    counted = df.withColumns(
        {
            "_words": words(F.col(text)),
            "_lines": lines,
            "n_symbols": (
                F.length(body) - F.length(F.regexp_replace(body, SYMBOLS + "+", ""))
            ).cast("long"),
        }
    )
    counted = counted.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hashes": _hashes(F.col("_words")),
        }
    )
    # Most short texts repeat no window, and only the others are sorted.
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    ordered = F.array_sort(
        F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    )
    counted = counted.withColumn("_pairs", F.when(repeats, ordered))
    covered = F.when(F.col("_pairs").isNotNull(), _covered(F.col("_pairs"))).otherwise(0)
    counted = counted.withColumn("n_repeat_words", covered.cast("long"))
    return fenced(counted.drop("_lines", "_hashes", "_pairs"), *RULES)


def buckets(w: Column, size: int = BUCKETS) -> Column:
    """Hash buckets of a text's words and pairs of neighbours."""
    last = F.size(w) - 2
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(size)).cast("int"))
    two = F.transform(
        at, lambda i: F.pmod(F.xxhash64(F.get(w, i), F.get(w, i + 1)), F.lit(size)).cast("int")
    )
    return F.concat(one, two)


def _apart() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)) == 0


def _marked(labels: DataFrame) -> DataFrame:
    """Each key once, with the least quality that it has."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("quality"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Keys of all trusted rows for the target distribution."""
    return _marked(labels.filter("quality = 1 and doc_id is not null").filter(~_apart()))


def held_back(labels: DataFrame) -> DataFrame:
    """All keys with their quality that the target has not seen."""
    known = labels.filter("quality in (0, 1) and doc_id is not null")
    return _marked(known.filter((F.col("quality") == 0) | _apart()))


def _of_keys(df: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """The rows that have a key of ``marks``, with its columns; few others are moved."""
    return maybe_among(df, marks.select(key)).filter("_maybe").drop("_maybe").join(marks, key)


def _bucket_counts(texts: DataFrame, text: str, size: int) -> list[int]:
    grams = texts.select(words(F.col(text)).alias("_words"))
    grams = grams.select(F.explode(buckets(F.col("_words"), size)).alias("bucket"))
    counts = [0] * size
    for row in grams.groupBy("bucket").count().collect():
        counts[row["bucket"]] = row["count"]
    return counts


def ratios(
    df: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", size: int = BUCKETS
) -> list[float]:
    """For each bucket the log ratio of its share in trusted texts to that in all texts.

    All texts are counted where they lie, and only those that may have a trusted key are
    joined to these.  Counts are combined before the shuffle and ``size`` rows of each
    count reach the driver.  Without any trusted row all ratios are 0.
    """
    marks = trusted.select(F.col("doc_id").alias(key))
    good = _bucket_counts(_of_keys(df.select(key, text), marks, key), text, size)
    if not sum(good):
        return [0.0] * size
    whole = _bucket_counts(df, text, size)
    return [_ratio(g, sum(good), n / sum(whole)) if n else 0.0 for g, n in zip(good, whole)]


def _ratio(good: int, all_good: int, share: float) -> float:
    """Log of a bucket's smoothed share in trusted texts over its share in all texts.

    The prior of the trusted texts is the corpus itself, so that few trusted texts
    say little instead of calling everything rare bad.
    """
    return math.log((good + PRIOR * share) / (all_good + PRIOR) / share)


def llr(grams: Column, table: list[float]) -> Column:
    """Mean ratio of a text's n-grams; 0 without any."""
    ratio = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")
    total = F.aggregate(grams, F.lit(0.0), lambda acc, b: acc + F.get(ratio, b))
    return total / F.greatest(F.size(grams), F.lit(1))


def best_threshold(good: list[float], bad: list[float]) -> float:
    """The value that parts good from bad scores best, each side counted as a share.

    Halfway between two neighbouring scores; of equally good places the lowest, which
    keeps most.  Without bad scores it is the lowest good one, and without good ones
    nothing is rejected.
    """
    if not good:
        return -math.inf
    if not bad:
        return min(good)
    marks = sorted([(x, 1 / len(good)) for x in good] + [(x, -1 / len(bad)) for x in bad])
    # Balance of what stays when everything up to a score is rejected.
    lost, best, threshold = 0.0, 0.0, -math.inf
    for (score, weight), (after, _) in zip(marks, [*marks[1:], (math.inf, 0)]):
        lost -= weight
        if lost > best + 1e-12 and after > score:
            best, threshold = lost, (score + after) / 2 if after < math.inf else after
    return threshold


def whole_threshold(scored: DataFrame) -> float:
    """What ``best_threshold`` says of a table of any size with ``quality``, 1 or 0, and ``llr``.

    Scores are counted in cells, whose sums the driver adds up; inside its cell each
    score is then ranked, so all of them count and no task sorts more than a cell.
    """
    good = F.sum((F.col("quality") == 1).cast("long")).alias("good")
    bad = F.sum((F.col("quality") == 0).cast("long")).alias("bad")
    scores = written(scored.groupBy("llr").agg(good, bad), "scores")
    shares = [i / SCORE_CELLS for i in range(1, SCORE_CELLS)]
    least = F.min(F.when(F.col("good") > 0, F.col("llr"))).alias("least")
    row = scores.agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad"), least,
        F.percentile_approx("llr", F.array(*map(F.lit, shares)), 10 * SCORE_CELLS).alias("edges"),
    ).first()
    if not row["good"]:
        return -math.inf
    if not row["bad"]:
        return row["least"]
    edges = F.array(*map(F.lit, sorted(set(row["edges"]))))
    cell = F.size(F.filter(edges, lambda e: e < F.col("llr")))
    celled = scores.withColumn("cell", cell)
    sums = celled.groupBy("cell").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.min("llr").alias("low"))
    before, next_, cells, all_good, all_bad = [], None, sums.orderBy("cell").collect(), 0, 0
    for r in cells:
        before.append([r["cell"], all_good, all_bad, None])
        all_good, all_bad = all_good + r["good"], all_bad + r["bad"]
    for at in range(len(cells) - 1, -1, -1):
        before[at][3], next_ = next_, cells[at]["low"]
    first = scores.sparkSession.createDataFrame(before, "cell int, good0 long, bad0 long, next double")
    inside = Window.partitionBy("cell").orderBy("llr")
    upto = celled.join(F.broadcast(first), "cell").select(
        "llr",
        (F.col("good0") + F.sum("good").over(inside)).alias("g"),
        (F.col("bad0") + F.sum("bad").over(inside)).alias("b"),
        F.coalesce(F.lead("llr").over(inside), "next").alias("after"),
    )
    # Balance of what stays when all up to a score goes, in whole numbers.
    wide = "decimal(38,0)"
    lost = F.col("b").cast(wide) * F.lit(all_good).cast("decimal(18,0)") - F.col("g").cast(wide) * F.lit(all_bad).cast("decimal(18,0)")
    best = upto.withColumn("lost", lost).filter("lost > 0").orderBy(F.desc("lost"), "llr").first()
    if best is None:
        return -math.inf
    return math.inf if best["after"] is None else (best["llr"] + best["after"]) / 2


def fit_threshold(
    df: DataFrame, known: DataFrame, table: list[float], text: str = "text", key: str = "doc_id"
) -> float:
    """The threshold from all labelled rows that pass the word rules."""
    marks = known.select(F.col("doc_id").alias(key), "quality")
    rows = with_rules(_of_keys(df.select(key, text), marks, key), text)
    return whole_threshold(
        rows.filter(~failed()).select(
            "quality", llr(buckets(F.col("_words"), len(table)), table).alias("llr")
        )
    )


def failed() -> Column:
    """Whether the word rules alone reject a text."""
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )


def judge(df: DataFrame, table: list[float], threshold: float, text: str = "text") -> DataFrame:
    """Add the word rules, ``llr``, ``base_failed`` and ``kept`` to each row.

    ``llr`` adds up the bucket ratios of a text's words and word pairs and divides by
    their number; a text is kept if it passes the word rules and its ``llr`` is at
    least the threshold.  No row is drawn by chance.  A null or blank text has no
    words, ``llr`` 0, and fails.  Repeated rows are judged one by one.
    """
    ruled = with_rules(df, text).withColumn("_grams", buckets(F.col("_words"), len(table)))
    judged = ruled.withColumn("llr", llr(F.col("_grams"), table))
    return judged.withColumns(
        {"base_failed": failed(), "kept": ~failed() & (F.col("llr") >= threshold)}
    ).drop("_words", "_grams")


def quality(df: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """Ratios of trusted rows to all, a threshold from labelled rows, the verdict on all rows."""
    table = ratios(df, trusted_ids(labels), text)
    return judge(df, table, fit_threshold(df, held_back(labels), table, text), text)
