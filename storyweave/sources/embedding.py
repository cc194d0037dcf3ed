"""Embedding hook: any batch encoder, applied in Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyweave.functions import text, vectors
from storyweave.session import cut_lineage

Encode = Callable[[list[str]], np.ndarray]
_TOKEN = re.compile(r"\w+")


def hashing_encoder(dims: int = 256, digest: Callable[[str], int] = xxhash.xxh64_intdigest) -> Callable[[], Encode]:
    """Deterministic signed token hashing over the whole text, unit length.
    ``digest`` gives 64 bits of a token: the first is its sign, all modulo
    ``dims`` its place."""
    def load() -> Encode:
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dims), dtype=np.float32)
            for row, body in enumerate(texts):
                keys = [digest(t) for t in _TOKEN.findall(body.lower())]
                if keys:
                    h = np.array(keys, dtype=np.uint64)
                    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
                    np.add.at(out[row], (h % np.uint64(dims)).astype(np.int64), sign)
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norms == 0, 1.0, norms)

        return encode

    return load


def md5_digest(token: str) -> int:
    """The first 64 bits of the MD5 of a token, which SQL engines know too."""
    return int.from_bytes(hashlib.md5(token.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()[:8], "big")


def embed_items(
    items: DataFrame, load: Callable[[], Encode], model_id: str, batch_size: int = 256
) -> tuple[DataFrame, DataFrame]:
    """(embedded, failed). ``load`` runs once per task; a batch that raises is
    tried again row by row, so one bad text fails alone. A vector with a NaN
    or an infinity fails too."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()

        def one(body: str) -> tuple[list[float] | None, str | None]:
            try:
                return [float(x) for x in np.asarray(encode([body]))[0]], None
            except Exception as exc:  # noqa: BLE001 - recorded as a failed row
                return None, f"embedding failed: {type(exc).__name__}: {exc}"

        for frame in batches:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start:start + batch_size]
                bodies = part["_body"].tolist()
                try:
                    rows = np.asarray(encode(bodies), dtype=np.float32)
                    if rows.shape[0] != len(bodies):
                        raise ValueError("encoder returned another number of rows")
                    pairs = [(r.tolist(), None) for r in rows]
                except Exception:  # noqa: BLE001 - fall back to single rows
                    pairs = [one(b) for b in bodies]
                yield pd.DataFrame({
                    "item_id": part["item_id"].to_numpy(), "embedding": [p[0] for p in pairs], "error": [p[1] for p in pairs],
                })

    bodies = items.select("item_id", text.embed_text(F.col("title"), F.col("text")).alias("_body"))
    encoded = bodies.mapInPandas(run, "item_id long, embedding array<float>, error string")
    # Arrow turns a NaN inside a list into NULL, which counts as not finite too
    finite = vectors.finite_vector(F.col("embedding"))
    # fixed value: the error text; both outputs read this table; the model must not run twice
    judged = cut_lineage(encoded.withColumn(
        "error", F.coalesce("error", F.when(~finite, F.concat(
            F.lit("embedding for item "), F.col("item_id").cast("string"), F.lit(" contains non-finite values")
        )))
    ))
    embedded = items.drop("embedding", "model_id").join(judged.where(F.col("error").isNull()).drop("error"), "item_id").withColumn(
        "model_id", F.lit(model_id)
    )
    failed = judged.where(F.col("error").isNotNull()).select("item_id", "error")
    return embedded, failed
