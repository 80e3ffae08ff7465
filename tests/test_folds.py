"""Cross-validation: every labelled window once, by a model that has not seen it."""

import pytest

from lexmill.operators import classifier


def test_folds(spark, monkeypatch):
    rows = [(f"the earlier view is {w} on point {i % 40}", label) for i in range(80) for w, label in (("overruled", "overruled"), ("followed", "followed"))] + [(None, "followed"), ("no label", None)]
    df = spark.createDataFrame(rows, "window string, label string")
    seen = []
    real = classifier.fit

    def spy(part, fit_rows):
        seen.append({r["fold"] for r in part.select("fold").distinct().collect()})
        return real(part, fit_rows)

    monkeypatch.setattr(classifier, "FEATURES", 1 << 10)
    monkeypatch.setattr(classifier, "fit", spy)
    got = classifier.cross_validated(df, 2).collect()
    assert seen == [{1}, {0}] and len(got) == 160
    assert sum(r["pred"] == r["label"] for r in got) > 150
    assert all(len({r["fold"] for r in got if r["window"] == w}) == 1 for w in {r["window"] for r in got})
    assert classifier.cross_validated(df.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        classifier.cross_validated(df, 1)
