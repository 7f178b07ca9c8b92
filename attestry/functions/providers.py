"""Model calls as providers: what is asked is deduplicated and looked up first, then asked in batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.text import fingerprint

BATCH = 96


class Embedder(Protocol):
    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashedWords:
    """A deterministic stand-in: words hashed into a fixed width."""

    model = "hashed"

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> list[list[float]]:
        from zlib import crc32

        out = []
        for t in texts:
            v = [0.0] * self.width
            for w in t.lower().split():
                v[crc32(w.encode()) % self.width] += 1.0
            out.append(v)
        return out


def embed(rows: DataFrame, cache: DataFrame, provider: Embedder) -> DataFrame:
    """(fingerprint, text, vector) of every distinct text: cached vectors as they are, the rest from the provider."""
    asked = rows.select("text").distinct().withColumn("fingerprint", fingerprint(F.lit(provider.model), F.col("text")))
    known = asked.join(cache.select("fingerprint", "vector"), "fingerprint").select("fingerprint", "text", "vector")
    new = asked.join(cache, "fingerprint", "left_anti").select("fingerprint", "text")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at : at + BATCH]
                yield part.assign(vector=provider.embed(part["text"].tolist()))

    return known.unionByName(new.mapInPandas(call, "fingerprint string, text string, vector array<double>"))
