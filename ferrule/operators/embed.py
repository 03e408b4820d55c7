"""Embedders: any function of a batch of texts becomes a column function."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrule.functions import constants as K
from ferrule.functions import text as T


def from_function(make: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 100) -> Callable[[Column], Column]:
    """make() runs once a Python worker task: load a model there."""

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = make()
        for s in series:
            texts = s.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in embed(texts[i : i + batch])], dtype=object)

    return run


def http(url: str, model: str, timeout: int = 300, batch: int = 100, eos: str = "") -> Callable[[Column], Column]:
    """A service that takes {model, input} and returns vectors with their index."""

    def make():
        def embed(texts: list[str]) -> list[list[float]]:
            body = json.dumps({"model": model, "input": texts}).encode()
            with urlopen(Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as r:
                data = json.load(r)["data"]
            return [x["embedding"] for x in sorted(data, key=lambda x: x["index"])]

        return embed

    run = from_function(make, batch)
    return (lambda c: run(T.with_eos(c, eos))) if eos else run


def local(model: str, batch: int = 100) -> Callable[[Column], Column]:
    """A model of the sentence-transformers library, where it is installed; each Python worker loads it once a task."""

    def make():
        from sentence_transformers import SentenceTransformer

        loaded = SentenceTransformer(model)
        return lambda texts: [[float(x) for x in v] for v in loaded.encode(texts)]

    return from_function(make, batch)


def dimension(model: str, explicit: int = 0) -> int:
    """Explicit; else that of the first known name within the model's; else of the Qwen3 family by scale (2560 unnamed); else 768."""
    low = model.lower().strip()
    known = (dim for name, (dim, _) in K.MODEL_DIMS.items() if name in low)
    family = (dim for scale, dim in K.QWEN3_DIMS.items() if scale in low) if "qwen3" in low else ()
    return explicit if explicit > 0 else next(known, None) or next(iter(family), 2560 if "qwen3" in low else 768)
