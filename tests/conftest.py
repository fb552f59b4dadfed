import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from barloom.session import local_session
    return local_session("8", 4)


@pytest.fixture(scope="session")
def walk(spark):
    """Random-walk hourly bars with gaps; one symbol holds most of the rows."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(5)
    parts = []
    for symbol, n in (("hot", 700), ("b", 120), ("tiny", 3)):
        hours = np.sort(rng.choice(n * 2, n, replace=False))
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        open_ = close * np.exp(rng.normal(0, 0.01, n))
        high = np.maximum(open_, close) * np.exp(np.abs(rng.normal(0, 0.01, n)))
        low = np.minimum(open_, close) * np.exp(-np.abs(rng.normal(0, 0.01, n)))
        parts.append(pd.DataFrame({
            "symbol": symbol, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(hours, "h"), "open": open_, "high": high,
            "low": low, "close": close, "volume": rng.integers(0, 50, n).astype(float)}))
    frame = pd.concat(parts, ignore_index=True)
    return frame, spark.createDataFrame(frame).cache()
