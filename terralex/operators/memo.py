"""Classification that remembers: key, cache lookup, call on misses, strict validation."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralex.functions.text import or_empty

#: A classifier: texts to raw responses (JSON). It is called once for each distinct key without a cached answer.
Classifier = Callable[[list[str]], list[str]]
MAX_EVIDENCE_WORDS = 20


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *(or_empty(p) for p in parts)), 256)


def parsed_label(raw: Column, field: str, labels: list[str], default: str) -> Column:
    """struct(label, confidence, evidence, status) of a response: from the first { to the last }, label from a list, confidence in [0, 1]."""
    cut = F.regexp_extract(or_empty(raw), r"(?s)\{.*\}", 0)
    v = F.from_json(cut, f"{field} string, confidence string, evidence_short string, error string", {"mode": "PERMISSIVE"})
    ok = (cut != "") & v.isNotNull() & (v[field].isNotNull() | v["confidence"].isNotNull() | v["evidence_short"].isNotNull())
    label = F.upper(F.trim(or_empty(v[field])))
    sure = F.coalesce(v["confidence"].try_cast("double"), F.lit(0.0))
    words = F.filter(F.split(F.trim(or_empty(v["evidence_short"])), r"\s+"), lambda w: w != "")
    return F.struct(
        F.when(ok & label.isin(labels), label).otherwise(default).alias("label"),
        F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure))).otherwise(0.0).alias("confidence"),
        F.when(ok, F.array_join(F.slice(words, 1, MAX_EVIDENCE_WORDS), " ")).otherwise("Invalid JSON.").alias("evidence"),
        F.when(ok, "ok").otherwise("error").alias("status"),
    )


def first_object(text: str) -> str | None:
    """The first balanced {...} of a text, aware of strings and escapes."""
    begin = text.find("{")
    while begin >= 0:
        depth, quoted, escaped = 0, False, False
        for i in range(begin, len(text)):
            c = text[i]
            if quoted:
                quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    return text[begin : i + 1]
        begin = text.find("{", begin + 1)
    return None


REFUSALS = ["cannot", "can't", "unable to", "no sentence"]


def sentiment_of(raw: str | None) -> tuple[str | None, float, str]:
    """label, confidence, status of a sentiment response: its JSON, else a refusal as neutral, else the first label named."""
    raw = raw or ""
    try:
        v = json.loads(first_object(raw) or "")
        label = str(v.get("sentiment", "")).strip().lower()
        if label in ("negative", "neutral", "positive"):
            try:
                sure = min(1.0, max(0.0, float(v.get("confidence", 0))))
            except (TypeError, ValueError):
                sure = 0.0
            return label, sure, "ok"
    except ValueError:
        pass
    low = raw.lower()
    if any(r in low for r in REFUSALS):
        return "neutral", 0.0, "ok"
    for label in ("negative", "neutral", "positive"):
        if label in low:
            return label, 0.0, "ok"
    return None, 0.0, "error"


def parsed_sentiments(df: DataFrame, raw: str) -> DataFrame:
    """Adds label, confidence and status of a column of sentiment responses."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parts = [sentiment_of(x) for x in f[raw]]
            yield f.assign(label=[p[0] for p in parts], confidence=[p[1] for p in parts], status=[p[2] for p in parts])

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInPandas(run, f"{schema}, label string, confidence double, status string")


def topic_key(text: Column, model: str, country: str, language: str, lexicon: dict[str, list[str]], think: bool = False) -> Column:
    """The cache key of a topic label: model, country, language and lexicon are part of it, so that none answers for another."""
    head = [json.dumps([model, think]), country, language, json.dumps(lexicon, ensure_ascii=False, sort_keys=True)]
    return fingerprint(*(F.lit(h) for h in head), text)


def location_key(text: Column, model: str, region: str, scope: list[str], document: Column | None = None, think: bool = False) -> Column:
    """The cache key of a location label, of a paragraph or, with its document's key, of a document."""
    head = [F.lit(json.dumps([model, think])), F.lit(region), F.lit(json.dumps(scope))]
    return fingerprint(*head, *([] if document is None else [F.lit("document"), document]), text)


def sentiment_key(text: Column, model: str, variant: str, language: str, think: bool = False) -> Column:
    return fingerprint(F.lit(json.dumps(think)), F.lit(model), F.lit(variant), F.lit(language), F.trim(or_empty(text)))


#: Levels of a place.
LEVELS = ["site", "city", "municipality", "province", "country", "none"]


def parsed_location(raw: Column) -> Column:
    """struct(location, granularity, confidence, reasoning, status) of a response; without a place or a known level it is NONE at level none."""
    cut = F.regexp_extract(or_empty(raw), r"(?s)\{.*\}", 0)
    v = F.from_json(cut, "location string, granularity string, confidence string, reasoning_short string", {"mode": "PERMISSIVE"})
    ok = (cut != "") & v.isNotNull() & (v["location"].isNotNull() | v["granularity"].isNotNull() | v["confidence"].isNotNull())
    place, level = F.trim(or_empty(v["location"])), F.lower(F.trim(or_empty(v["granularity"])))
    found = ok & level.isin(LEVELS[:-1]) & ~F.lower(place).isin("", "none", "nan", "null")
    words = F.filter(F.split(F.trim(or_empty(v["reasoning_short"])), r"\s+"), lambda w: w != "")
    return F.struct(
        F.when(found, place).otherwise("NONE").alias("location"),
        F.when(found, level).otherwise("none").alias("granularity"),
        F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(v["confidence"].try_cast("double"), F.lit(0.0))))).otherwise(0.0).alias("confidence"),
        F.when(ok, F.array_join(F.slice(words, 1, MAX_EVIDENCE_WORDS), " ")).otherwise("Invalid JSON.").alias("reasoning"),
        F.when(ok, "ok").otherwise("error").alias("status"),
    )


ASPECT = "struct<phrase: string, category: string, polarity: string, certainty: string>"


def aspects(raw: Column, categories: list[str]) -> Column:
    """array of struct(phrase, category, polarity, certainty) of a response's aspects: those without a phrase go, unknown categories are other, unknown polarities neutral."""
    v = F.from_json(F.regexp_extract(or_empty(raw), r"(?s)\{.*\}", 0), f"is_opinion boolean, aspects array<{ASPECT}>", {"mode": "PERMISSIVE"})
    known = lambda c, values, other: F.when(F.lower(F.trim(or_empty(c))).isin(values), F.lower(F.trim(c))).otherwise(other)
    clean = lambda x: F.struct(
        F.trim(x["phrase"]).alias("phrase"), known(x["category"], categories, "other").alias("category"), known(x["polarity"], ["positive", "negative", "neutral", "mixed"], "neutral").alias("polarity"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x["certainty"].try_cast("double"), F.lit(0.0)))).alias("certainty"),
    )
    kept = F.transform(F.filter(v["aspects"], lambda x: F.trim(or_empty(x["phrase"])) != ""), clean)
    empty = F.array().cast("array<struct<phrase: string, category: string, polarity: string, certainty: double>>")
    return F.when(F.coalesce(v["is_opinion"], F.lit(False)), F.coalesce(kept, empty)).otherwise(empty)


def zipped_aspects(df: DataFrame, columns: list[str], others: list[str]) -> DataFrame:
    """One row for each place of parallel arrays; a row without any stays, with nulls."""
    rows = df.select(*others, F.explode_outer(F.arrays_zip(*columns)).alias("_a"))
    return rows.select(*others, *(F.col("_a")[c].alias(c) for c in columns))


#: Names of sentiment classes, and what each stands for.
CLASSES = {
    "1": "negative", "2": "negative", "very negative": "negative", "negative": "negative",
    "3": "neutral", "neutral": "neutral",
    "4": "positive", "5": "positive", "very positive": "positive", "positive": "positive",
}
UNSUPPORTED = "__unsupported__"
SENTIMENTS = {"pos": "positive", "positive": "positive", "neg": "negative", "negative": "negative", "neu": "neutral", "neutral": "neutral", "neutral-uncertain": "neutral"}


def sentiment_class(label: Column) -> Column:
    """One of three classes for a model's label; a question is unsupported, an unknown label null."""
    name = F.lower(label)
    return F.when(name == "question", UNSUPPORTED).otherwise(F.try_element_at(F.create_map(*(F.lit(x) for kv in CLASSES.items() for x in kv)), name))


def collapsed(df: DataFrame, key: str, label: str, probability: str) -> DataFrame:
    """key, prediction, confidence: a model's probabilities summed to three classes, and the likeliest; of equal ones the first by name."""
    sums = df.groupBy(key, sentiment_class(F.col(label)).alias("prediction")).agg(F.sum(probability).alias("confidence"))
    return sums.groupBy(key).agg(F.min_by(F.struct("prediction", "confidence"), F.struct(-F.col("confidence"), "prediction")).alias("m")).select(key, "m.*")


def sentiment_name(c: Column) -> Column:
    """positive, negative or neutral for the usual spellings, else null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in SENTIMENTS.items() for x in kv)), F.lower(F.trim(or_empty(c))))


def probe(df: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Rows with their cached value (the last of a key counts), and the distinct keys without any. cache: key, value, seq."""
    last = cache.where(f"{key} is not null and value is not null").groupBy(key).agg(F.max_by("value", "seq").alias("value"))
    return df.join(last, key, "left"), df.join(last, key, "left_anti").dropDuplicates([key])


class Passing(Exception):
    """What a classifier raises where another attempt may succeed: a timeout, a lost connection, an answer of the server."""


def attempt(classifier: Classifier, text: str, attempts: int = 3, wait: tuple[float, float] = (1.0, 10.0)) -> tuple[str | None, str | None]:
    """Response, or the error of the last attempt; passing ones are tried again after a wait that doubles up to a limit."""
    for i in range(attempts):
        try:
            return classifier([text])[0], None
        except (Passing, TimeoutError, ConnectionError) as e:
            error = f"{type(e).__name__}: {e}"
            if i + 1 < attempts:
                time.sleep(min(wait[1], wait[0] * 2**i))
        except Exception as e:  # any other error is the row's, not the job's  # noqa: BLE001
            return None, f"{type(e).__name__}: {e}"
    return None, error


def memo_classify(df: DataFrame, text: str, key: Column, cache: DataFrame, classifier: Classifier, answers: str, wait: tuple[float, float] = (1.0, 10.0)) -> tuple[DataFrame, DataFrame]:
    """Rows with raw response, status (ok, empty, error) and error, and the new cache entries (key, value, seq).

    Empty texts are never sent; each other distinct key that the cache lacks is sent once: the answers are written
    to the folder `answers` in shared storage first, and both results read them there. A call that fails for good
    leaves its rows with status error and its message, and no cache entry, so that a later run asks again.
    """
    df = df.withColumn("key", key)
    blank = F.trim(or_empty(F.col(text))) == ""
    _, missing = probe(df.where(~blank), cache)

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            said = [attempt(classifier, t, wait=wait) for t in f[text]]
            yield pd.DataFrame({"key": f["key"], "value": [v for v, _ in said], "error": [e for _, e in said]})

    missing.select("key", text).mapInPandas(call, "key string, value string, error string").write.mode("overwrite").parquet(answers)
    said = df.sparkSession.read.parquet(answers)
    new = said.where("value is not null").select("key", "value", F.lit(2**62).alias("seq"))
    rows, _ = probe(df, cache.select("key", "value", "seq").unionByName(new))
    rows = rows.join(said.where("value is null").select("key", "error"), "key", "left")
    status = F.when(blank, "empty").when(F.col("value").isNull(), "error").otherwise("ok")
    return rows.withColumn("status", status).withColumnRenamed("value", "raw"), new
