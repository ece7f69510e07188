"""Embedding drift: distance to a running mean, scored against its own history."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pulsegrain.runtime import ship

SCHEMA = "key long, item long, distance double, z double"
ALPHA = 0.05


def _fold(cold: int):
    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item")
        mean, distances, centre, spread = None, [], 0.0, 0.0
        out = []
        for n, (item, vector) in enumerate(zip(rows["item"], rows["embedding"], strict=True)):
            vector = np.asarray(vector, float)
            mean = vector.copy() if mean is None else mean
            distance, z = float(np.linalg.norm(vector - mean)), None
            if n < cold:
                mean = mean + (vector - mean) / (n + 1)
                distances.append(distance)
                if n == cold - 1:
                    centre, spread = float(np.mean(distances)), float(np.std(distances))
            else:
                z = (distance - centre) / spread if spread > 1e-9 else 0.0
                if abs(z) < 3:
                    mean = mean + ALPHA * (vector - mean)
                    centre += ALPHA * (distance - centre)
                    spread = float(np.sqrt((1 - ALPHA) * spread**2 + ALPHA * (distance - centre) ** 2))
            out.append((rows["key"].iloc[0], item, distance, z))
        return pd.DataFrame(out, columns=["key", "item", "distance", "z"])

    return fold


def drift(vectors: DataFrame, cold: int = 100) -> DataFrame:
    """Rows of (key, item, embedding) in item order: L2 distance, and a z-score after a cold start."""
    ship(vectors.sparkSession)
    return vectors.select("key", "item", "embedding").groupBy("key").applyInPandas(_fold(cold), SCHEMA)
