import datetime as dt
import math

import numpy as np

from quillcast.operators import retrieval as T


def test_own_terms_of_windows_and_mean_idf(spark, monkeypatch):
    """Each window's questions bring their own terms alone; terms of one day and of several count in the mean idf."""
    asked = []
    kept = T._Asked
    monkeypatch.setattr(T, "_Asked", lambda *a: asked.append(kept(*a)) or asked[-1])
    day = lambda i: dt.date(2024, 1, 1 + i)
    rows = [(i, day(i % 6), ["all", f"own{i}", f"pair{i // 2}", "x" * (i % 3 + 1)]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc long, day date, terms array<string>")
    asks = [(1, day(2), ["own7", "own8", "all"]), (2, day(5), ["pair9", "xx"])]
    got = {(r.q, r.doc): r.score for r in T.bm25(docs, spark.createDataFrame(asks, "q long, cut date, terms array<string>"), "q", 100, days=2).collect()}
    assert sorted(len(a.places) for a in asked) == [1, 3]  # pair9 is in no document of its window
    want = {}
    for q, cut, terms in asks:
        own = [(d, t) for d, on, t in rows if 0 <= (cut - on).days <= 2]
        df = {t: sum(t in ts for _, ts in own) for _, ts in own for t in ts}
        idf = {t: math.log(len(own) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
        floor = 0.25 * np.mean(list(idf.values()))
        for d, ts in own:
            if set(ts) & set(terms):
                want[q, d] = round(sum((floor if idf[t] < 0 else idf[t]) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 4 / 4)) for t in terms if t in ts), 6)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
