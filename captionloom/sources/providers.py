"""Providers and media tools: effects outside the query, plugged in as functions.

A recogniser or translator is a Python callable, called a batch at a time on the executors; adapters
for network services live with their operators, this module has the contracts and fakes for tests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame

from captionloom.plans.engine import ProviderError, ProviderUnavailable

TRANSLATED = "job_id string, batch int, id string, text string, uncertain boolean, notes string"


class Recogniser(Protocol):
    def __call__(self, path: str, *, language: str, min_confidence: float) -> str:
        """The response's JSON for an audio file."""


class Translator(Protocol):
    def __call__(self, segments: list[dict], *, source_language: str, target_language: str, terms: list[str]) -> list[dict]:
        """A dict of id, text, uncertain and notes for each segment."""


class Registry:
    """Providers by name; a kind that is not registered is unavailable."""

    def __init__(self):
        self._made: dict[str, Callable] = {}

    def register(self, name: str, provider: Callable) -> None:
        self._made[name] = provider

    def get(self, name: str) -> Callable:
        if name not in self._made:
            raise ProviderUnavailable(f"no provider {name}")
        return self._made[name]


def check_loopback(url: str) -> str:
    """Local model servers are reached on the loopback interface, over plain HTTP and without credentials."""
    u = urlsplit(url)
    if u.scheme != "http" or u.hostname not in ("127.0.0.1", "localhost", "::1") or u.username or u.password:
        raise ProviderError("the server's address is not a loopback address")
    return url


def recognise(chunks: DataFrame, provider: Recogniser, language: str, min_confidence: float) -> DataFrame:
    """(job_id, part, offset, path) -> (job_id, part, offset, payload): one call a chunk, on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"job_id": b["job_id"], "part": b["part"], "offset": b["offset"], "payload": [provider(p, language=language, min_confidence=min_confidence) for p in b["path"]]})

    return chunks.select("job_id", "part", "offset", "path").mapInPandas(run, "job_id string, part int, offset double, payload string")


def translate(batched: DataFrame, provider: Translator, source_language: str, target_language: str, terms: list[str]) -> DataFrame:
    """Segments with `batch` -> TRANSLATED rows: one call a batch."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        got = provider(pdf[["id", "text"]].to_dict("records"), source_language=source_language, target_language=target_language, terms=terms)
        if len({g["id"] for g in got}) != len(got) or {g["id"] for g in got} != set(pdf["id"]):
            raise ProviderError("the translation has other segments than the batch")
        return pd.DataFrame([(pdf["job_id"].iloc[0], int(pdf["batch"].iloc[0]), g["id"], g["text"], bool(g.get("uncertain")), g.get("notes", "")) for g in got], columns=[c.split()[0] for c in TRANSLATED.split(", ")])

    return batched.groupBy("job_id", "batch").applyInPandas(run, TRANSLATED)
