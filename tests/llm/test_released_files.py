"""op6 lets go of the shuffle files it no longer needs, and its results stay those of one pass."""

from pairloom.llm import deleted_interpolation as di


def test_events_are_released_before_the_rare_words(spark, monkeypatch):
    seen = []
    release = di._release
    monkeypatch.setattr(di, "_release", lambda s: (seen.append(s), release(s)))
    docs = spark.createDataFrame([(i, f"a b {'c' if i % 2 else 'd'} w{i}", i % 3) for i in range(12)], "doc_id long, text string, fold int")
    found = {r["doc_id"]: r for r in di.score(docs).collect()}
    # after the learning, and after the sums of the common words
    assert len(seen) == 2
    assert set(found) == set(range(12)) and all(r["n_tokens"] == 5 for r in found.values())
