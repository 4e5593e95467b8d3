"""Two languages in one space, held against the SQL: repeated ids and missing languages, and no text joined with a text."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from wordloom.operators import bilingual
from wordloom.plans import catalog


@pytest.mark.parametrize("most", [bilingual.MOST_BROADCAST, 0])
def test_pairs_are_counted_and_texts_are_split_once(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(bilingual, "MOST_BROADCAST", most)
    rng = np.random.default_rng(7)
    words = ["aa", "bb", "cc", "x", "été", "größe", *(f"w{chr(97 + i)}" for i in range(12))]
    rows = [(int(i), " ".join(rng.choice(words, rng.integers(0, 30))), ("en", "fr", "de", None)[rng.integers(4)]) for i in rng.integers(-5, 40, 120)]
    rows += [(None, "aa bb", "en"), (41, None, "fr"), (42, "aa", "en"), (43, "", "de")]
    pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows], "lang": [r[2] for r in rows]}).to_parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    df = catalog.QUERIES["bilingual_vectors"](spark, str(tmp_path))
    got, want = df.toPandas(), con.execute(catalog.ORACLES["bilingual_vectors"]).df()
    assert set(want.side) == {"l1", "l2"} and (want.val == 0).any()
    sort = lambda p: p[["side", "object", "dim", "val"]].sort_values(["side", "object", "dim"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(sort(got), sort(want), check_dtype=False)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "HashAggregate" not in plan
    assert ("BroadcastHashJoin" if most else "ShuffledHashJoin") in plan


def test_an_empty_corpus_gives_no_vectors(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalog.QUERIES["bilingual_vectors"](spark, str(tmp_path)).count() == 0
