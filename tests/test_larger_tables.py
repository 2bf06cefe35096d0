"""Queries against their SQL on tables that reach the operators' fixed limits."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from compare import rows, tables
from corpusloom.operators import drift as D
from corpusloom.plans import catalog


def same(spark, at, name):
    got, want = catalog.QUERIES[name](spark, str(at)).toPandas(), tables(str(at)).execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    return got


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    """Two days up to the two ends of windows with more scores than a window's cap, the older ones higher."""
    at, out = tmp_path_factory.mktemp("events"), []
    for end in (dt.datetime(2024, 1, 8, 12), dt.datetime(2024, 1, 15, 12)):
        for i in range(D.CAP + 2000):
            out.append((len(out), end - dt.timedelta(seconds=6 * (i // 2)), i % 40, ("view", "click", "error")[i % 3], 1.0 * i, f'{{"k": {i % 60 + (39 if i > D.CAP else 0)}}}'))
    df = pd.DataFrame(out, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    df["ts"] = df["ts"].astype("datetime64[us]")
    df.to_parquet(at / "events.parquet", index=False)
    return at


@pytest.mark.parametrize("name", ["f03_drift_metrics", "f04_set_baseline", "f05_check_drift"])
def test_windows_of_more_scores_than_the_cap(spark, events, name):
    assert same(spark, events, name)["n"].tolist() == [D.CAP]


def test_baseline_of_more_scores_than_the_cap_on_a_stream(spark, events):
    assert len(same(spark, events, "t05_drift_checks"))


def test_long_responses_are_not_short(spark, tmp_path):
    texts = ["a" * 60_000, "b", None, "c" * 49_000]
    pd.DataFrame({"doc_id": range(6, 34, 7), "text": texts}).to_parquet(tmp_path / "documents.parquet", index=False)
    got = same(spark, tmp_path, "e18_length_issues").set_index("doc_id")
    assert got.loc[6].tolist() == [True, False] and got.loc[20].tolist() == [True, False]
    pd.DataFrame({"doc_id": range(4), "text": texts}).to_parquet(tmp_path / "documents.parquet", index=False)
    got = same(spark, tmp_path, "e18_length_issues").set_index("doc_id")
    assert [got.loc[i].tolist() for i in range(4)] == [[False, True], [False, False], [True, False], [False, False]]


def test_halves_of_the_answer_cache_are_cut_at_one_time(spark, tmp_path, monkeypatch):
    """On several executors an approximate median is another each time; here it is another for each run that asks for it."""
    start = dt.datetime(2024, 1, 1)
    df = pd.DataFrame([(i, start + dt.timedelta(minutes=97 * i), i % 10, "view", 1.0, '{"k": 1}') for i in range(3000)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    df["ts"] = df["ts"].astype("datetime64[us]")
    df.to_parquet(tmp_path / "events.parquet", index=False)
    median = F.percentile_approx
    moved = F.pmod(F.unix_millis(F.current_timestamp()) * 7919, F.lit(500_000))
    monkeypatch.setattr(F, "percentile_approx", lambda *a: median(*a) + moved)
    assert len(same(spark, tmp_path, "t09_answer_cache")) > 2000


def test_answers_live_to_the_millisecond_of_the_sql(spark, tmp_path):
    start, day = dt.datetime(2024, 1, 1), dt.timedelta(days=1)
    out = []
    for user, (stored, asked) in enumerate([(600, 1400), (400, 600), (1499, 1500), (0, 0), (999, 1499)]):
        out += [(6 * user, start + dt.timedelta(microseconds=stored), user), (6 * user + 1, start + day + dt.timedelta(microseconds=asked), user)]
    out += [(3000, start + 3 * day, 9)]
    df = pd.DataFrame([(i, ts, user, "view", 1.0, '{"k": 1}') for i, ts, user in out], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    df["ts"] = df["ts"].astype("datetime64[us]")
    df.to_parquet(tmp_path / "events.parquet", index=False)
    got = same(spark, tmp_path, "t09_answer_cache")
    assert (got["outcome"] == "hit").sum() == 3
