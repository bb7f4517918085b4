"""Embedding providers: hashed TF-IDF from the corpus, or vectors from a client.

The client is a function from a batch of texts to vectors, so any service can
be plugged in; a null result from a client stands for a text it rejected.
"""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ProviderConfig

Client = Callable[[list[str]], list[list[float]]]
BATCH = 32
FALLBACK_DIMENSION = 1024


class Provider(Protocol):
    kind: str
    id: str
    dimension: int
    local: bool

    def release(self) -> None: ...


class LexicalProvider:
    kind, local = "lexical", True

    def __init__(self, dimension: int = 4096):
        if dimension <= 0:
            raise ValueError("dimension must be a positive integer")
        self.dimension = dimension
        self.id = f"lexical:{dimension}"

    def release(self) -> None:
        """Holds nothing."""


class RejectedBatch(Exception):
    """The service refuses a batch as such; its halves are then tried."""


def parse_embeddings(body: object, n: int) -> list[list[float]]:
    """The vectors of a response ``{"data": [{"embedding": [...]}]}`` with exactly ``n`` rows of finite numbers."""
    data = body.get("data") if isinstance(body, dict) else None
    if not isinstance(data, list) or len(data) != n:
        raise ValueError(f"expected {n} embeddings")
    out = []
    for item in data:
        v = item.get("embedding") if isinstance(item, dict) else None
        if not isinstance(v, list) or not v or not all(isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) for x in v):
            raise ValueError("an embedding must be a non-empty list of finite numbers")
        out.append([float(x) for x in v])
    return out


def http_client(config: ProviderConfig) -> Client:
    def call(texts: list[str]) -> list[list[float]]:
        request = urllib.request.Request(f"{config.base_url}/embeddings", json.dumps({"model": config.model, "input": texts}).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {config.api_key}"})
        try:
            with urllib.request.urlopen(request, timeout=config.timeout_ms / 1000) as answer:
                return parse_embeddings(json.load(answer), len(texts))
        except urllib.error.HTTPError as e:
            if e.code == 400:
                raise RejectedBatch(str(e)) from e
            raise

    return call


def _unit(v: list[float]) -> list[float]:
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm for x in v] if norm else v


class ClientProvider:
    kind, local = "openai", False

    def __init__(self, config: ProviderConfig, client: Client | None = None):
        self.config, self.dimension = config, config.dimension
        self.id = f"openai:{config.base_url}:{config.model}"
        self.client = client or http_client(config)
        self._made: list[DataFrame] = []

    def embed_texts(self, texts: list[str]) -> list[list[float] | None]:
        """Unit vectors of one batch; None for texts that the service rejects also alone.

        A refused batch is halved until the refused texts stand alone: one of
        32 takes at most 11 calls.  All calls of a batch share one deadline.
        """
        ends = time.monotonic() + self.config.timeout_ms / 1000

        def vectors(part: list[str]) -> list[list[float] | None]:
            if time.monotonic() > ends:
                raise TimeoutError(f"no embeddings within {self.config.timeout_ms} ms")
            try:
                return [_unit(v) for v in self.client(part)]
            except RejectedBatch:
                if len(part) == 1:
                    return [None]
            half = len(part) // 2
            return vectors(part[:half]) + vectors(part[half:])

        return vectors([t[: self.config.max_chars_per_text] for t in texts])

    def embed(self, units: DataFrame) -> DataFrame:
        """``unit_id, v`` of ``units(unit_id, text)``; rejected texts get zeros, mixed dimensions raise.

        The vectors are held until ``release``, so that no text is sent twice.
        """
        call = self.embed_texts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, BATCH):
                    part = batch.slice(low, BATCH)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(call([t or "" for t in part.column(1).to_pylist()]), pa.list_(pa.float32()))], names=["unit_id", "v"])

        made = units.selectExpr("cast(unit_id AS long)", "cast(text AS string)").mapInArrow(run, "unit_id long, v array<float>").persist()
        self._made.append(made)
        low, high = made.agg(F.min(F.size("v")), F.max(F.size("v"))).where("true").first()
        if high is not None and (low != high and low > 0 or self.dimension and self.dimension != high):
            raise ValueError(f"mixed dimensions: {low} and {high}")
        self.dimension = self.dimension or max(high or 0, 0)
        return made.select("unit_id", F.coalesce("v", F.array_repeat(F.lit(0).cast("float"), self.dimension)).alias("v"))

    def release(self) -> None:
        while self._made:
            self._made.pop().unpersist()


def create_provider(config: ProviderConfig, client: Client | None = None) -> LexicalProvider | ClientProvider:
    return LexicalProvider(config.dimension) if config.kind == "lexical" else ClientProvider(config, client)
