"""Quality rules by a hashed n-gram log-likelihood ratio; DataFrame functions only.

Unigrams and bigrams of words are hashed into BUCKETS.  Two smoothed multinomials
over the buckets are estimated: the raw corpus from all documents, the trusted
target from documents labelled good.  A document's verdict is the mean over its
n-grams of log(target / raw), compared with a cut.  Bucket weights are integers
(millionths of a nat), so sums do not depend on their order.

The more distinct n-grams share a bucket, the closer every ratio comes to 0.  So the
cut is not fixed: it is what best parts labelled good documents from bad ones (the
largest difference of the shares below it) on the scores of this very table.  One in
HELD good documents is kept out of the target for that, for the target's own
documents score too well.

Target documents are all those labelled quality 1 and not toxic, but for the held ones,
and the cut is found on all held good ones and all bad ones.  Counts of the raw corpus
cover every document.  Labelled ids are broadcast up to BROADCAST_LABELS of them and
joined by a shuffle beyond; besides, only the BUCKETS weights travel.

Inputs and edge cases
* null and empty texts have no words: all counts 0, base_failed and not kept.
* null doc_id is kept as null and never labelled; repeated rows are judged one by one.
* no labels (or none good): the target is the raw corpus, every ratio is 0, and only
  the base rules decide.  Repeated or conflicting labels: any good one counts.
* under LEAST_LABELLED held good or bad labels, or documents of theirs with
  LEAST_WORDS: the cut is THRESHOLD (with too few labels nothing is held out).
* windows are compared by 64-bit hash and then by their words.
* other columns travel in a struct, so their names cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SOLID_WORD, WHITE

BUCKETS = 1 << 14
#: Labelled ids that are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 1 << 22
SMOOTHING = 0.5
#: Weight of the target's prior, which is the raw corpus, against the target's own counts.
PRIOR_SHARE = 0.5
#: Mean log ratio below which a document is rejected where labels do not give a cut.
THRESHOLD = -0.06
#: One in so many good documents is held out of the target to find the cut.
HELD = 4
LEAST_LABELLED = 10
#: Millionths of a nat between the cuts that are tried.
CUT_STEP = 500
SCALE = 1_000_000
LEAST_WORDS = 50
MOST_REPEATED = 50


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({SOLID_WORD})"), F.lit(1)), F.array().cast("array<string>"))


def _bucket(*words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(BUCKETS).cast("long"))


def _tally(texts: DataFrame) -> DataFrame:
    """bucket, n: n-gram counts with a map-side sum; at most BUCKETS rows leave a task."""
    split = texts.select(_words(F.col("text")).alias("words"))
    ones = split.select(F.explode(F.transform("words", lambda w: _bucket(w))).alias("bucket"))
    n = F.size("words")
    pairs = split.select(F.explode(F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: _bucket(F.get("words", i - 1), F.get("words", i))))).alias("bucket"))
    return ones.groupBy("bucket").count().unionByName(pairs.groupBy("bucket").count()).groupBy("bucket").agg(F.sum("count").alias("n"))


def _labelled(labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Ids of the target, of good documents held out of it, and of bad ones; the last is None where they are too few."""
    is_good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    ids = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.coalesce(is_good, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("quality") == 0, F.lit(False))).alias("bad"))
    ids = ids.withColumn("held", F.col("good") & (F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(HELD)) == 0))
    held, bad = ids.filter("held").select("doc_id"), ids.filter("bad and not good").select("doc_id")
    if min(held.count(), bad.count()) < LEAST_LABELLED:
        return ids.filter("good").select("doc_id"), held, None
    return ids.filter("good and not held").select("doc_id"), held, bad


def _of(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs joined with the labelled ids."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_LABELS else ids, "doc_id", how)


def bucket_weights(docs: DataFrame, labels: DataFrame) -> list[int]:
    """Per bucket log(target / raw) in millionths of a nat."""
    texts = docs.select(F.col("doc_id"), F.col("text"))
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in _tally(texts).collect():  # at most BUCKETS rows
        raw[r["bucket"]] = r["n"]
    for r in _tally(_of(texts, _labelled(labels)[0], "left_semi")).collect():
        target[r["bucket"]] = r["n"]
    if not sum(target):
        return [0] * BUCKETS
    n_raw, n_target = sum(raw) + SMOOTHING * BUCKETS, (1 + PRIOR_SHARE) * sum(target)
    # the target's prior is the raw corpus, so a bucket that a small target lacks by chance costs little
    prior = PRIOR_SHARE * sum(target)
    return [round(SCALE * math.log(((t + prior * (r + SMOOTHING) / n_raw) / n_target) / ((r + SMOOTHING) / n_raw))) for t, r in zip(target, raw)]


def _analysed(docs: DataFrame) -> DataFrame:
    """docs as struct `doc`, with words, n and the base counts.

    For repeated windows, each 3-word window is packed as hash bits above its
    position; sorting the packed longs brings equal windows together.  Equal
    neighbours, checked word by word, give the repeated positions, and what they
    cover is the sum of the steps between them, three words at most each.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text.alias("text"), _words(text).alias("words"))
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: x.rlike(SOLID_WORD))
    rows = rows.select(
        "doc",
        "words",
        F.size("words").alias("n"),
        F.length(F.regexp_replace("text", WHITE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    # packed windows: the high bits are the hash, the low bits the position
    rows = rows.withColumn("bits", F.length(F.bin(F.col("n").cast("long"))))
    packed = F.when(
        F.col("n") >= 3,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.col("n") - 3),
                lambda i: F.call_function("shiftleft", F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)), F.col("bits")).bitwiseOR(i.cast("long")),
            )
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select("doc", "words", "n", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "bits", packed.alias("packed"))
    high = lambda x: F.call_function("shiftright", x, F.col("bits"))
    low = lambda x: (x - F.call_function("shiftleft", high(x), F.col("bits"))).cast("int")

    def same(x: Column, y: Column) -> Column:
        a, b = low(x), low(y)
        return (high(x) == high(y)) & (F.get("words", a) == F.get("words", b)) & (F.get("words", a + 1) == F.get("words", b + 1)) & (F.get("words", a + 2) == F.get("words", b + 2))

    # pairs of equal neighbours first: few windows repeat, so the word comparison runs on few
    pairs = F.filter(
        F.transform(F.when(F.size("packed") > 1, F.sequence(F.lit(1), F.size("packed") - 1)).otherwise(F.array().cast("array<int>")), lambda j: F.when((high(F.get("packed", j)) == high(F.get("packed", j - 1))), j)),
        lambda j: j.isNotNull(),
    )
    rows = rows.withColumn("pairs", pairs)
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("pairs", lambda j: F.when(same(F.get("packed", j), F.get("packed", j - 1)), F.array(low(F.get("packed", j)), low(F.get("packed", j - 1)))).otherwise(F.array().cast("array<int>"))))))
    rows = rows.withColumn("places", places)
    covered = F.aggregate("places", F.struct(F.lit(0).alias("upto"), F.lit(0).alias("total")), lambda acc, p: F.struct((p + 3).alias("upto"), (acc["total"] + p + 3 - F.greatest(p, acc["upto"])).alias("total")))["total"]
    return rows.select("doc", "words", "n", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


def _weights_column(weights: list[int]) -> Column:
    """The weights as a foldable array: bounded by BUCKETS, carried once in the plan."""
    return F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")


def _ratio(weights: Column) -> Column:
    """Mean nats per n-gram of `words`, n in number; null without words."""
    n = F.col("n")
    total = F.aggregate(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        F.lit(0).cast("long"),
        lambda acc, i: acc + F.get(weights, _bucket(F.get("words", i)).cast("int")) + F.when(i + 1 < n, F.get(weights, _bucket(F.get("words", i), F.get("words", i + 1)).cast("int"))).otherwise(F.lit(0)),
    )
    return F.when(n > 0, total.cast("double") / (F.lit(float(SCALE)) * (2 * n - 1)))


def label_cut(docs: DataFrame, labels: DataFrame, weights: list[int]) -> float:
    """The ratio below which the share of bad documents exceeds that of held good ones most.

    Cuts are multiples of CUT_STEP; of equal ones the least, which rejects fewest.
    Only the counts by step come to the driver, and steps are bounded by the range of weights.
    """
    _, held, bad = _labelled(labels)
    if bad is None:
        return THRESHOLD
    ids = held.withColumn("good", F.lit(1)).unionByName(bad.withColumn("good", F.lit(0)))
    words = _of(docs.select("doc_id", "text"), ids, "inner").select("good", _words(F.col("text")).alias("words")).withColumn("n", F.size("words")).filter(F.col("n") >= LEAST_WORDS)
    steps = words.select("good", F.floor(_ratio(_weights_column(weights)) * SCALE / CUT_STEP).alias("step")).groupBy("step").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")).orderBy("step").collect()
    n_good, n_bad = sum(r["good"] for r in steps), sum(r["bad"] for r in steps)
    if min(n_good, n_bad) < LEAST_LABELLED:
        return THRESHOLD
    best = below_good = below_bad = 0
    cut = steps[0]["step"]
    for r in steps:
        below_good, below_bad = below_good + r["good"], below_bad + r["bad"]
        gain = below_bad * n_good - below_good * n_bad
        if gain > best:
            best, cut = gain, r["step"] + 1
    return cut * CUT_STEP / SCALE


def _base_failed() -> Column:
    return (F.col("n") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n"))


def base_counts(docs: DataFrame) -> DataFrame:
    """docs as struct `doc` with the base counts and base_failed of ``judge``; without labels and weights, which they do not need."""
    return _analysed(docs).select("doc", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", _base_failed().alias("base_failed"))


def judge(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """docs as struct `doc` with base counts, base_failed, llr (mean nats per n-gram) and kept.

    One projection over the scan: nothing is shuffled but the two bucket tallies and
    the labelled documents' counts by step.
    """
    found = bucket_weights(docs, labels)
    if threshold is None:
        threshold = label_cut(docs, labels, found)
    rows = _analysed(docs).withColumn("llr", _ratio(_weights_column(found)))
    failed = _base_failed()
    return rows.select(
        "doc",
        F.col("n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & F.coalesce(F.col("llr") >= threshold, F.lit(False))).alias("kept"),
        "llr",
        # a filter on the verdict must not be pushed below: it would repeat all expressions
        F.monotonically_increasing_id().alias("row_mark"),
    )


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the rules keep."""
    return judge(docs, labels).filter(F.col("kept") & (F.col("row_mark") >= 0)).select("doc.*")


def op3_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text"), labels).select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


BASE_ORACLE = r"""
with w as (select doc_id, coalesce(text, '') text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
g as (select doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] g from (select doc_id, w, unnest(range(1, len(w) - 1)) i from w)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) n from g) where n > 1),
repeats as (select doc_id, count(distinct j)::bigint n from (select doc_id, unnest(range(i, i + 3)) j from twice) group by doc_id),
counts as (
  select w.doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines, coalesce(n, 0) n_repeat_words
  from w left join repeats using (doc_id))
select doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed
from counts
"""
