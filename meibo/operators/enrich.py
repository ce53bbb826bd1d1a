"""Enrichment over distinct values with a cache: distinct, minus the cache, provider in batches, cache appended, joined back."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list[str]], list[str | None]]


def enrich(df: DataFrame, column: str, provider: Provider, name: str, cache: str | None = None, batch: int = 10) -> DataFrame:
    """``df`` with ``name``: the provider's answer for each distinct value of ``column``.

    ``cache`` is a Parquet folder of (key, value): known keys are not asked again and new answers are appended, so a
    run that breaks off resumes.  Null keys are not asked.  A provider that fails for a batch answers null for it.
    """
    spark = df.sparkSession
    keys = df.select(F.col(column).cast("string").alias("key")).where("key is not null").distinct()
    known = None
    if cache and _exists(spark, cache):
        known = spark.read.schema("key string, value string").parquet(cache)
        keys = keys.join(known, "key", "left_anti")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[str | None] = []
            ks = pdf["key"].tolist()
            for i in range(0, len(ks), batch):
                part = ks[i : i + batch]
                try:
                    got = provider(part)
                except Exception:  # noqa: BLE001 - one failing batch must not end the run
                    got = [None] * len(part)
                out += list(got)
            yield pd.DataFrame({"key": ks, "value": out})

    fresh = keys.mapInPandas(ask, "key string, value string")
    if cache:
        fresh.write.mode("append").parquet(cache)
        answers = spark.read.schema("key string, value string").parquet(cache).dropDuplicates(["key"])
    else:
        answers = fresh
    return df.join(answers.select(F.col("key").alias(column), F.col("value").alias(name)), column, "left")


_NUMBERED = re.compile(r"^\s*(\d+)\.\s*(.+?)\s*$", re.M)


def numbered_answers(reply: str | None, n: int) -> list[str | None]:
    """The n answers of a reply of numbered lines; numbers out of range are ignored, missing ones null, of repeated ones the last counts."""
    out: list[str | None] = [None] * n
    for m in _NUMBERED.finditer(reply or ""):
        if 1 <= int(m.group(1)) <= n:
            out[int(m.group(1)) - 1] = m.group(2)
    return out


def yes_no_provider(ask: Callable[[str], str]) -> Provider:
    """A provider of verdicts: keys are asked as numbered lines in one prompt; what is not answered with YES or NO, or fails, is NO."""

    def answer(keys: list[str]) -> list[str | None]:
        try:
            reply = ask("\n".join(f"{i}. {k}" for i, k in enumerate(keys, 1)))
        except Exception:  # noqa: BLE001 - a failing call confirms nothing
            reply = ""
        return ["yes" if (a or "").upper().startswith("YES") else "no" for a in numbered_answers(reply, len(keys))]

    return answer


def verify_pairs(pairs: DataFrame, a: str, b: str, provider: Provider, cache: str | None = None, batch: int = 20) -> DataFrame:
    """The pairs that the provider confirms, each distinct (a, b) asked once as "a | b"; with a cache a rerun asks only what is new."""
    keyed = pairs.withColumn("_pair", F.concat_ws(" | ", a, b))
    return enrich(keyed, "_pair", provider, "_verdict", cache, batch).where("_verdict = 'yes'").select(*pairs.columns)


def _exists(spark, path: str) -> bool:  # noqa: ANN001
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def rule_provider(rules: list[tuple[str, str]], default: str = "") -> Provider:
    """A deterministic offline provider: the first rule whose word is in the value."""

    def answer(values: list[str]) -> list[str | None]:
        return [next((v for k, v in rules if k in x), default) for x in values]

    return answer
