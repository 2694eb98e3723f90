"""Embedding models behind the embedding slot (V1, V2, V8): loaded once a worker process, run on Arrow batches."""

from __future__ import annotations

import threading
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOADED: dict[str, Callable[[list[str]], np.ndarray]] = {}
_LOCK = threading.Lock()


def once(name: str, load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable[[list[str]], np.ndarray]:
    """This process's encoder of that name; `load` makes it at the first call."""
    with _LOCK:
        if name not in _LOADED:
            _LOADED[name] = load()
        return _LOADED[name]


def model_embedding(name: str, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 32) -> Callable[[Column], Column]:
    """An `embed` for the engine: texts to vectors of length 1. load: () -> (list of texts -> rows of numbers); null counts as empty."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        encode = once(name, load)
        values = texts.fillna("").tolist()
        out: list[list[float]] = []
        for i in range(0, len(values), batch):
            v = np.asarray(encode(values[i : i + batch]), dtype=float)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            out += (v / np.where(n == 0, 1.0, n)).tolist()
        return pd.Series(out, dtype=object)

    embed.model = name  # an index that another model has made is not amended
    return embed


def onnx_loader(folder: str, longest: int = 256) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Loader of `model.onnx` and `tokenizer.json` in a folder that every worker can read: mean of the last states over the tokens."""

    def load() -> Callable[[list[str]], np.ndarray]:
        import onnxruntime
        from tokenizers import Tokenizer

        session = onnxruntime.InferenceSession(f"{folder}/model.onnx", providers=["CPUExecutionProvider"])
        tokenizer = Tokenizer.from_file(f"{folder}/tokenizer.json")
        tokenizer.enable_truncation(longest)
        tokenizer.enable_padding()
        names = {i.name for i in session.get_inputs()}

        def encode(texts: list[str]) -> np.ndarray:
            rows = tokenizer.encode_batch(texts)
            mask = np.array([r.attention_mask for r in rows], np.int64)
            given = {"input_ids": np.array([r.ids for r in rows], np.int64), "attention_mask": mask, "token_type_ids": np.zeros_like(mask)}
            states = session.run(None, {k: v for k, v in given.items() if k in names})[0]
            return (states * mask[:, :, None]).sum(axis=1) / np.maximum(1, mask.sum(axis=1, keepdims=True))

        return encode

    return load
