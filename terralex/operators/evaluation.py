"""Selective classification, samples and splits, merges of labels."""

from __future__ import annotations

import hashlib
import json
from decimal import ROUND_HALF_EVEN, Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Bits of a hash by which documents are counted in blocks.
BITS = 12


def scores(df: DataFrame, keys: list[str], labels: list[str], gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """n, accuracy and macro-F1 over a fixed label set, by keys; an absent class counts as F1 0."""
    aggs = [F.count("*").alias("n"), F.avg((F.col(gold) == F.col(predicted)).cast("double")).alias("accuracy")]
    f1 = []
    for i, x in enumerate(labels):
        both = F.sum(((F.col(gold) == x) & (F.col(predicted) == x)).cast("long"))
        any_ = F.sum((F.col(gold) == x).cast("long")) + F.sum((F.col(predicted) == x).cast("long"))
        aggs.append(F.coalesce(F.try_divide(2 * both, any_), F.lit(0.0)).alias(f"_f{i}"))
        f1.append(F.col(f"_f{i}"))
    out = (df.groupBy(*keys) if keys else df).agg(*aggs)
    return out.select(*keys, "n", "accuracy", F.when(F.col("n") > 0, reduce(lambda a, b: a + b, f1) / len(labels)).alias("macro_f1"))


def threshold_curve(df: DataFrame, confidence: str = "confidence", gold: str = "gold", predicted: str = "predicted", keys: list[str] | None = None, valid: str | None = None) -> DataFrame:
    """keys, threshold, n_accepted, coverage, accuracy of what is accepted at each distinct confidence, 0 and 1; rows that aren't valid are never accepted, but count for coverage.

    Counts by confidence are accumulated from the top; so it is one pass, not a join of thresholds and rows.
    """
    keys = keys or []
    good = F.col(valid) if valid else F.lit(True)
    by = df.groupBy(*keys, F.col(confidence).cast("double").alias("threshold")).agg(F.count("*").alias("rows"), F.count_if(good).alias("n"), F.count_if(good & (F.col(gold) == F.col(predicted))).alias("right"))
    ends = F.explode(F.array(F.struct(F.lit(0.0).alias("threshold")), F.struct(F.lit(1.0).alias("threshold"))))
    groups = by.select(*keys).distinct() if keys else by.sparkSession.range(1).select()
    by = by.unionByName(groups.select(*keys, ends.alias("e")).select(*keys, "e.threshold", *(F.lit(0).cast("long").alias(c) for c in ("rows", "n", "right"))))
    by = by.groupBy(*keys, "threshold").agg(*(F.sum(c).alias(c) for c in ("rows", "n", "right")))
    down = Window.partitionBy(*keys).orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("rows").over(Window.partitionBy(*keys))
    out = by.withColumns({"n_accepted": F.sum("n").over(down), "hits": F.sum("right").over(down), "total": total})
    return out.select(*keys, "threshold", "n_accepted", F.try_divide("n_accepted", "total").alias("coverage"), F.try_divide("hits", "n_accepted").alias("accuracy"))


def macro_f1(df: DataFrame, keys: list[str], wanted: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """keys, macro_f1: the mean F1 over the labels that `wanted` (keys, label) lists for a group; a label without any row counts 0."""
    hit = (F.col(gold) == F.col(predicted)).cast("long")
    sides = F.array(F.struct(F.col(gold).alias("label"), hit.alias("twice")), F.struct(F.col(predicted).alias("label"), hit.alias("twice")))
    f1 = df.select(*keys, F.explode(sides).alias("s")).groupBy(*keys, "s.label").agg((F.sum("s.twice") / F.count("*")).alias("f1"))
    return wanted.join(f1, [*keys, "label"], "left").groupBy(*keys).agg(F.avg(F.coalesce("f1", F.lit(0.0))).alias("macro_f1"))


def evaluated(df: DataFrame, labels: dict[str, list[str]], least_coverage: float) -> DataFrame:
    """A report for each model, task and subset.

    df: model, task, subset, gold, prediction, confidence, valid, error, seconds. A task's labels are those given for it, else
    those found. Of the thresholds of enough coverage the best is chosen; a model all of whose rows failed has no scores.
    """
    keys = ["model", "task", "subset"]
    fixed = F.create_map(*(x for t, ls in labels.items() for x in (F.lit(t), F.array(*(F.lit(v) for v in ls))))) if labels else F.lit(None).cast("map<string,array<string>>")
    found = F.collect_set(F.col("gold")), F.collect_set(F.when(F.col("valid"), F.col("prediction")))
    wanted = df.groupBy(*keys).agg(F.coalesce(F.try_element_at(fixed, F.first("task")), F.array_distinct(F.concat(*found))).alias("l")).select(*keys, F.explode("l").alias("label"))
    curve = threshold_curve(df, predicted="prediction", keys=keys, valid="valid")
    best = Window.partitionBy(*keys).orderBy(F.desc("accuracy"), F.desc("coverage"), "threshold")
    chosen = curve.where((F.col("coverage") >= least_coverage) & F.col("accuracy").isNotNull()).withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*keys, "threshold", "coverage", "n_accepted", F.col("accuracy").alias("accepted_accuracy"))
    accepted = df.where("valid").join(chosen.select(*keys, "threshold"), keys).where("confidence >= threshold")
    failed = F.col("error") != ""
    base = df.groupBy(*keys).agg(F.count("*").alias("n_samples"), F.avg((F.col("gold") == F.col("prediction")).cast("double")).alias("accuracy"), F.count_if(failed).alias("errors"), F.sum("seconds").alias("runtime_seconds"), F.avg("seconds").alias("mean_seconds_per_sample"))
    out = base.join(macro_f1(df, keys, wanted, predicted="prediction"), keys, "left").join(chosen, keys, "left")
    out = out.join(macro_f1(accepted, keys, wanted.join(accepted.select(*keys).distinct(), keys, "left_semi"), predicted="prediction").withColumnRenamed("macro_f1", "accepted_macro_f1"), keys, "left")
    setup = F.col("errors") == F.col("n_samples")
    status = F.when(setup, "model setup failed").when(F.col("threshold").isNotNull(), "ok").otherwise("no threshold meets minimum coverage")
    scored = {c: F.when(~setup, F.col(c)) for c in ("accuracy", "macro_f1")}
    return out.withColumns(scored | {"coverage": F.coalesce("coverage", F.lit(0.0)), "n_accepted": F.coalesce("n_accepted", F.lit(0)), "status": status})


def model_summary(report: DataFrame, tasks: dict[str, str]) -> DataFrame:
    """A row for each model: accuracy, f1, threshold and coverage by task (tasks: column name to task), and seconds a sample over tasks that ran.

    report: row (order), model, task, subset and the columns of `evaluated`. Of a task's rows for all samples the last counts;
    setups that failed give nothing. A share outside [0, 1] or a time below 0 fails the job when the summary is computed.
    """
    rows = report.where("subset = 'all'")
    last = rows.groupBy("model", "task").agg(F.max_by(F.struct("status", "n_samples", "errors", "accuracy", "macro_f1", "threshold", "coverage", "runtime_seconds"), "row").alias("m")).select("model", "task", "m.*")
    usable = (F.col("n_samples") > 0) & (F.col("errors") < F.col("n_samples"))
    ran = F.when(usable & (F.col("status") != "model setup failed"), True)
    checked = lambda c: F.when(c.isNull() | c.between(0, 1), c).otherwise(F.raise_error(F.concat(F.lit("outside [0, 1]: "), c.cast("string"))).cast("double"))
    values = []
    for name, task in tasks.items():
        for column, metric in (("accuracy", "accuracy"), ("f1", "macro_f1"), ("threshold", "threshold"), ("coverage", "coverage")):
            values.append(checked(F.max(F.when(ran & (F.col("task") == task), F.col(metric)))).alias(f"{name}_{column}"))
    timed = F.col("task").isin(list(tasks.values())) & usable
    seconds = F.try_divide(F.sum(F.when(timed, F.col("runtime_seconds"))), F.sum(F.when(timed, F.col("n_samples"))))
    seconds = F.when(seconds.isNull() | (seconds >= 0), seconds).otherwise(F.raise_error(F.lit("negative seconds")).cast("double"))
    return last.groupBy("model").agg(*values, seconds.alias("average_runtime_seconds"))


def rescored(predictions: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last prediction (by row) of each model, task and sample; and problems: samples that a model's task lacks or has too many. samples: task, sample_id."""
    keys = ["model", "task", "sample_id"]
    last = predictions.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in predictions.columns if c not in (*keys, "row"))), "row").alias("m")).select(*keys, "m.*")
    wanted = predictions.select("model", "task").distinct().join(samples, "task")
    missing = wanted.join(last.select(*keys), keys, "left_anti").select(*keys, F.lit("missing").alias("problem"))
    extra = last.select(*keys).join(samples, ["task", "sample_id"], "left_anti").select(*keys, F.lit("unexpected").alias("problem"))
    return last, missing.union(extra)


def with_document_seconds(df: DataFrame, documents: DataFrame, document: str, source: str) -> DataFrame:
    """Adds document_seconds: the time of a document's call (documents: document, seconds) in equal parts to its rows that were answered by it; seconds grow by it."""
    called = F.col(source).isin("document_llm", "country_fallback")
    n = F.sum(called.cast("long")).over(Window.partitionBy(document))
    df = df.withColumn("_n", n).join(documents.select(document, F.col("seconds").alias("_s")), document, "left")
    df = df.withColumn("document_seconds", F.when(called, F.coalesce(F.col("_s") / F.col("_n"), F.lit(0.0))).otherwise(0.0))
    return df.withColumn("seconds", F.col("seconds") + F.col("document_seconds")).drop("_n", "_s")


def signature(config: dict, code: dict[str, str]) -> str:
    """A hash of a configuration and of the digests of the code that it runs: predictions are reused only under the same one."""
    return hashlib.sha256(json.dumps({"config": config, "code": code}, sort_keys=True).encode()).hexdigest()


def resumable(saved: DataFrame, signatures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Saved predictions that may be used again, and models and tasks whose saved ones were made by other code or settings. signatures: model, task, signature.

    Failed ones are left out; those of models and tasks that aren't asked for too.
    """
    rows = saved.where("coalesce(error, '') = ''").join(signatures.withColumnRenamed("signature", "_now"), ["model", "task"])
    return rows.where("signature = _now").drop("_now"), rows.where("signature <> _now").select("model", "task").distinct()


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", left_unique: bool = False) -> DataFrame:
    """A join to a side of unique keys; a repeated key fails the job instead of multiplying rows."""
    once = lambda d, side: d.withColumn("_times", F.count("*").over(Window.partitionBy(*keys))).where(F.when(F.col("_times") > 1, F.raise_error(F.lit(f"repeated keys on the {side}")).cast("boolean")).otherwise(True)).drop("_times")
    return (once(left, "left") if left_unique else left).join(once(right, "right"), keys, how)


def blind_sample(df: DataFrame, text: str, n: int, seed: int = 42) -> DataFrame:
    """n distinct texts (without regard to case and blanks), those of the least hashes, numbered in order of their keys; of equal ones the row with the least text."""
    key = F.sha2(F.trim(F.regexp_replace(F.lower(F.col(text)), r"\s+", " ")), 256)
    rows = df.where(F.trim(F.col(text)) != "").withColumn("sample_key", key).groupBy("sample_key").agg(F.min(F.struct(F.col(text), *(c for c in df.columns if c != text))).alias("m")).select("sample_key", "m.*")
    chosen = rows.orderBy(hash_order("sample_key", seed), "sample_key").limit(n)
    return chosen.withColumn("sample_id", F.row_number().over(Window.orderBy("sample_key")))  # n rows


def staged_samples(stages: list[tuple[str, DataFrame, int, int]], key: str) -> DataFrame:
    """A sample for each stage (name, rows, how many, seed), numbered through in order of stages and hashes."""
    rows = None
    for i, (name, df, n, seed) in enumerate(stages):
        one = hash_sample(df.select(F.col(key)), key, n, seed).select(F.lit(i).alias("_i"), F.lit(name).alias("stage"), F.col(key), hash_order(key, seed).alias("_h"))
        rows = one if rows is None else rows.union(one)
    return rows.withColumn("sample_id", F.row_number().over(Window.orderBy("_i", "_h", key))).drop("_i", "_h")  # as many rows as are sampled


def save_conflicts(saved: DataFrame, edits: DataFrame, key: str, version: str = "updated") -> DataFrame:
    """key, state of each edit: saved, or conflict where the row has changed since it was read (edits: key, read version)."""
    now = saved.select(key, F.col(version).alias("_now"))
    return edits.join(now, key, "left").select(key, F.when(F.col(version).eqNullSafe(F.col("_now")), "saved").otherwise("conflict").alias("state"))


def chosen_threshold(curve: DataFrame, min_coverage: float) -> DataFrame:
    """The most accurate threshold of enough coverage; then more coverage, then the lower one."""
    return curve.where(F.col("coverage") >= min_coverage).where("accuracy is not null").orderBy(F.desc("accuracy"), F.desc("coverage"), "threshold").limit(1)


def hash_order(key: str, seed: int):
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def document_split(df: DataFrame, document: str, fraction: float = 0.3, seed: int = 42) -> DataFrame:
    """document, split: the share of documents (at least one, halves to even) with the least hashes is `test`.

    Only the block of hashes (by their first BITS bits) that the border falls into is put in order, so no task holds all documents.
    """
    docs = df.select(document).distinct().withColumn("_h", hash_order(document, seed)).withColumn("_b", F.conv(F.substring("_h", 1, BITS // 4), 16, 10).cast("int"))
    blocks = sorted((r["_b"], r["n"]) for r in docs.groupBy("_b").agg(F.count("*").alias("n")).collect())  # 2^BITS rows at most
    total = sum(n for _, n in blocks)
    share = Decimal(str(fraction)) * total
    left = max(1, int(share.to_integral_value(ROUND_HALF_EVEN)))
    border = -1
    for border, n in blocks:
        if n >= left:
            break
        left -= n
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", document))
    last = docs.where(F.col("_b") == border).withColumn("_r", rank).select(document, F.when(F.col("_r") <= left, "test").otherwise("train").alias("split"))
    return docs.where(F.col("_b") != border).select(document, F.when(F.col("_b") < border, "test").otherwise("train").alias("split")).union(last)


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42, strata: list[str] | None = None) -> DataFrame:
    """n rows (of each stratum) with the least hashes of their key."""
    h = hash_order(key, seed)
    if not strata:
        return df.orderBy(h, key).limit(n)
    w = Window.partitionBy(*strata).orderBy(h, key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def balanced_assignment(df: DataFrame, key: str, raters: list[str]) -> DataFrame:
    """Shares of consecutive keys, the first ones larger by one at most.

    The borders are keys, found by selecting their ranks among counts of ranges of keys; no task orders all rows.
    """
    spark = df.sparkSession
    cuts = df.select(key).repartitionByRange(F.col(key)).groupBy(F.spark_partition_id().alias("_p")).agg(F.min(key).alias("_low"))
    lows = sorted(r["_low"] for r in cuts.collect() if r["_low"] is not None)  # a key for each partition
    part = F.size(F.filter(F.lit(lows), lambda c: c <= F.col(key))) if lows else F.lit(0)
    df = df.withColumn("_p", F.when(F.col(key).isNull(), 0).otherwise(part))
    sizes = dict(df.groupBy("_p").count().collect())
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    offsets = spark.createDataFrame(list(before.items()) or [(0, 0)], "_p int, _before long")
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(key)) + F.col("_before")
    ends, end = [], 0
    for i in range(len(raters)):
        end += total // len(raters) + (i < total % len(raters))
        ends.append(end)
    ranked = df.join(F.broadcast(offsets), "_p").withColumn("_rank", rank)  # a row for each partition
    rater = F.coalesce(*(F.when(F.col("_rank") <= e, F.lit(r)) for r, e in zip(raters, ends, strict=True)))
    return ranked.withColumn("rater", rater).drop("_p", "_before", "_rank")


def three_way_merge(baseline: DataFrame, current: DataFrame, incoming: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, state: unchanged, updated, kept, conflict; a conflict keeps the current value."""
    b, c, i = (d.select(key, F.col(value).alias(n)) for d, n in ((baseline, "b"), (current, "c"), (incoming, "i")))
    m = c.join(b, key, "left").join(i, key, "left")
    theirs = F.col("i").isNotNull() & ~F.col("i").eqNullSafe(F.col("b"))
    ours = ~F.col("c").eqNullSafe(F.col("b"))
    conflict = theirs & ours & ~F.col("i").eqNullSafe(F.col("c"))
    state = F.when(conflict, "conflict").when(theirs, "updated").when(ours, "kept").otherwise("unchanged")
    return m.select(key, F.when(theirs & ~conflict, F.col("i")).otherwise(F.col("c")).alias(value), state.alias("state"))


def merge_report(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old with the same keys; the others stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def bucket(key: str, n: int = 100):
    """A stable bucket of a key."""
    return (F.crc32(F.col(key).cast("string").cast("binary")) % n).cast("int")


def whole_merge(baseline: DataFrame, current: DataFrame, incoming: DataFrame, key: str, value: str) -> DataFrame:
    """three_way_merge that is all or nothing: a conflict fails the job, and says how many there are."""
    merged = three_way_merge(baseline, current, incoming, key, value)
    if n := merged.where("state = 'conflict'").count():
        raise ValueError(f"{n} rows were changed on both sides")
    return merged


def topped_up_sample(df: DataFrame, key: str, stratum: str, per_stratum: int, total: int, seed: int = 42) -> DataFrame:
    """So many rows of each stratum, those of the least hashes, and of the others as many, in order of hashes, as are missing to the total; numbered in a shuffled order."""
    h = hash_order(key, seed)
    w = Window.partitionBy(stratum).orderBy("_h", key)
    ranked = df.withColumn("_h", h).withColumn("_extra", F.row_number().over(w) > per_stratum)
    chosen = ranked.orderBy("_extra", "_h", key).limit(total)
    return chosen.withColumn("sample_id", F.row_number().over(Window.orderBy(hash_order(key, seed + 1), key))).drop("_h", "_extra")  # `total` rows


def shared_assignment(sample: DataFrame, order: str, raters: list[str], overlap: int) -> DataFrame:
    """A row for each rater of each sample: the first ones in order go to all raters, the others by turns."""
    turn = F.element_at(F.array(*(F.lit(r) for r in raters)), ((F.col(order) - 1) % len(raters) + 1).cast("int"))
    return sample.withColumn("rater", F.explode(F.when(F.col(order) <= overlap, F.array(*(F.lit(r) for r in raters))).otherwise(F.array(turn))))


def expanded_judgements(samples: DataFrame, judgements: DataFrame, key: str, seen: str) -> DataFrame:
    """samples with the decision on their name, and whether it is stale: what was judged (seen) isn't what the sample holds now, or nobody decided.

    judgements: key, decision, seen, updated; of a name's the latest counts, a conflict of decisions gives none.
    """
    groups = judgements.groupBy(key).agg(F.max_by(F.struct("decision", F.col(seen).alias("_seen")), "updated").alias("m"), F.countDistinct("decision").alias("_n"))
    out = samples.join(groups, key, "left")
    ok = F.col("_n") == 1
    return out.withColumns({"decision": F.when(ok, F.col("m.decision")), "conflict": F.coalesce(F.col("_n") > 1, F.lit(False)), "stale": F.coalesce(ok & ~F.col("m._seen").eqNullSafe(F.col(seen)), F.lit(False))}).drop("m", "_n")


def changed_rows(now: DataFrame, then: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, problem of rows whose other columns aren't those that were handed out (changed), that are new or gone."""
    a, b = (d.select(key, F.struct(*columns).alias(n)) for d, n in ((now, "_a"), (then, "_b")))
    both = a.join(b, key, "full_outer")
    problem = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "gone").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def judgement_groups(df: DataFrame, key: str, decision: str, updated: str) -> DataFrame:
    """key, decision (latest), n, conflict, complete of the judgements of each unique name."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.max_by(decision, F.struct(updated, decision)).alias("decision"), (F.countDistinct(decision) > 1).alias("conflict"), F.every(F.col(decision).isNotNull()).alias("complete"))


def gold_problems(gold: DataFrame, manifest: DataFrame, key: str, label: str, labels: list) -> DataFrame:
    """key and problem of annotations that break the rules: repeated, unexpected or missing keys, labels outside the domain."""
    n = gold.groupBy(key).agg(F.count("*").alias("n"), F.max((~F.coalesce(F.col(label).isin(labels), F.lit(False))).cast("int")).alias("odd"))
    both = n.join(manifest.select(key).distinct().withColumn("listed", F.lit(True)), key, "full_outer")
    found = {"repeated": F.col("n") > 1, "unexpected": F.col("listed").isNull(), "missing": F.col("n").isNull(), "label": F.col("odd") == 1}
    problems = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in found.items())))
    return both.select(key, F.explode(problems).alias("problem"))


def refreshed_queue(queue: DataFrame, fresh: DataFrame, key: str, label: str, stage: tuple[str, str] | None = None) -> DataFrame:
    """Annotated rows of the queue as they are, then the fresh rows of other keys; rows without a label go unless they are fresh. state: kept, refreshed or added.

    With a stage (column, name) only its rows are refreshed; those of other stages stay as they are.
    """
    other = None
    if stage:
        column, name = stage
        other = queue.where(~F.col(column).eqNullSafe(F.lit(name)))
        queue, fresh = queue.where(F.col(column) == name), fresh.withColumn(column, F.lit(name))
    kept = queue.where(F.col(label).isNotNull())
    if other is not None:
        kept = kept.unionByName(other)
    waiting = queue.where(F.col(label).isNull()).select(key).distinct().withColumn("waited", F.lit(True))
    new = fresh.join(kept.select(key), key, "left_anti").join(waiting, key, "left")
    new = new.withColumn("state", F.when(F.col("waited"), "refreshed").otherwise("added")).drop("waited")
    return kept.withColumn("state", F.lit("kept")).unionByName(new, allowMissingColumns=True)
