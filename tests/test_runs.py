"""Runs of equal keys over batches that are cut anywhere."""

from __future__ import annotations

import pandas as pd
import pytest

from kinescribe.operators.transcript import _runs


@pytest.mark.parametrize("cut", [1, 2, 3, 4, 100])
def test_runs_do_not_depend_on_the_batches(cut):
    keys = [(None, 0)] * 2 + [(None, 1)] + [("a", 0)] * 5 + [("a", 1)] * 3 + [("b", 1)] + [("c", 1)] * 2
    pdf = pd.DataFrame({"s": [k[0] for k in keys], "c": [k[1] for k in keys], "n": range(len(keys))})
    calls = []

    def work(key, own):
        calls.append((key, own["n"].tolist()))
        return {"n": own["n"], "rows": [len(own["n"])] * len(own["n"])}

    over = _runs(["s", "c"], work, ["n", "rows"])
    got = pd.concat(over(pdf.iloc[a : a + cut] for a in range(0, len(pdf), cut)))
    assert got["n"].tolist() == list(range(len(keys)))
    assert calls == [(k, [i for i, x in enumerate(keys) if x == k]) for k in dict.fromkeys(keys)]
    assert got["rows"].tolist() == [keys.count(k) for k in keys]
