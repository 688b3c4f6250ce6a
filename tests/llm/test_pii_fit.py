import numpy as np

from wardlight.llm import pii


def test_every_candidate_is_fitted(spark, monkeypatch):
    """More plain candidates than the 10,000 that a fit once took."""
    stored = {}
    keep = pii.store

    def watched(session, df, name):
        stored[name] = keep(session, df, name)
        return stored[name]

    monkeypatch.setattr(pii, "store", watched)
    texts = [" ".join(f"user{i}x{j}@mail{j % 7}.example.org" for j in range(400)) + " see https://host/a [at] b [dot] com/x" for i in range(30)]
    trees = pii.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert stored["pii-forms"].filter("NOT loose AND kind = 0").count() == 12_000
    assert stored["pii-candidates"].filter("NOT loose AND kind = 0").count() == 12_000
    assert trees is not None


def test_thresholds_against_a_sorted_list(spark):
    rng = np.random.default_rng(5)
    rows = []
    for kind in range(4):   # 0: looser held out; 1: none of them positive; 2: none of the looser ones; 3: no positive at all
        for _ in range(400):
            loose, train, raw = bool(rng.integers(2)), bool(rng.integers(2)), float(np.round(rng.normal(), 3))
            good = float(raw + rng.normal() * 0.3 > 0)
            if not [True, not loose or train, not loose, False][kind]:
                raw, good = raw - 5, 0.0
            rows.append((kind, good, loose, train, raw))
    expected = {}
    for kind in range(4):
        own = [r for r in rows if r[0] == kind and r[2]]
        held = [r for r in own if not r[3]]
        held = held if any(r[1] for r in held) else own
        held = held if any(r[1] for r in held) else [r for r in rows if r[0] == kind]
        for raw in sorted({r[4] for r in held}):
            above = [r[1] for r in held if r[4] >= raw]
            if sum(above) / len(above) >= 0.9:
                expected[kind] = raw - 1e-9
                break
    judged = spark.createDataFrame(rows, "kind int, label double, loose boolean, train boolean, raw double")
    assert pii._thresholds(judged, 0.9) == expected and set(expected) == {0, 1, 2}
