"""Every registered query of the engine against its SQL oracle on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from galewatch import catalog

DATA = os.environ.get("GALEWATCH_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def _cell(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    return f"{v:.5f}" if isinstance(v, float) else str(v)


def _rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(map(_cell, r)) for r in df[cols].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_its_oracle(spark, duck, name):
    got, want = catalog.queries()[name](spark, DATA).toPandas(), duck.execute(catalog.oracle_sql()[name]).fetchdf()
    assert _rows(got) == _rows(want)


#: Queries that SQL cannot express, and the file that recomputes each.
RECOMPUTED = {
    "track_assign": "test_tracks", "trajectories": "test_tracks", "ridge_fit": "test_models", "autoregression": "test_models", "radius_sweep": "test_models",
    "transition_fit": "test_models", "transition_oof": "test_models", "transition_serve": "test_models", "downscaling_scores": "test_models", "streamed_track_ids": "test_tracks",
}


def test_every_query_has_an_oracle_or_a_recomputation():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == set(RECOMPUTED)
    for name, file in RECOMPUTED.items():
        assert f'"{name}"' in open(os.path.join(os.path.dirname(__file__), f"{file}.py")).read()
