"""Queries that fit with the operators' own numbers of trees, depths and folds."""

import pytest

from ledgerlens.models.registry import component
from ledgerlens.workload import learning, load


class Asked(Exception):
    pass


@pytest.mark.parametrize("name, fit, want", [("train_gbt", "fit_model", ("xgboost",)), ("stacked_model", "fit_stacked", ())])
def test_no_parameter_shrinks_the_fit(monkeypatch, name, fit, want):
    def asked(train, *args, **params):
        raise Asked(args, params)

    monkeypatch.setattr(learning, "prepared", lambda *_: (None, None, None))
    monkeypatch.setattr(learning.t, fit, asked)
    with pytest.raises(Asked) as found:
        load().QUERIES[name](None, "")
    assert found.value.args == (want, {})


def test_own_numbers(spark):
    built = component("xgboost").build()
    assert (built.getMaxIter(), built.getMaxDepth()) == (120, 8)
    built = component("lightgbm").build()
    assert (built.getMaxIter(), built.getMaxDepth()) == (120, 6)
    built = component("tabtransformer").build()
    assert (built.getNumTrees(), built.getMaxDepth()) == (300, 16)
