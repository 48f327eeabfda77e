"""Registered resampling queries draw as many replicates as the operators' defaults and the reference."""

import inspect

import pytest

from modalens.operators import bootstrap, groups
from modalens.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("query", "module", "operator", "least"),
    [
        ("e7_auroc_interval", bootstrap, "auroc_interval", 1000),
        ("e8_paired_gain", bootstrap, "paired_gain", 1000),
        ("e12_mean_interval", bootstrap, "mean_interval", 2000),
        ("e13_sign_flip", bootstrap, "sign_flip", 999),
        ("g7_class_by_batch", groups, "class_by_batch", 199),
        ("g7_class_by_batch_permuted", groups, "class_by_batch", 199),
        ("g11_feature_association", groups, "feature_association", 99),
    ],
)
def test_replicates(spark, monkeypatch, query, module, operator, least):
    real, seen = getattr(module, operator), []

    def spy(*args, **kwargs):
        bound = inspect.signature(real).bind(*args, **kwargs)
        bound.apply_defaults()
        seen.append(bound.arguments["reps"])
        return real(*args, **kwargs)

    monkeypatch.setattr(module, operator, spy)
    assert registry.queries()[query](spark, SF).columns and seen and min(seen) >= least


def test_class_by_batch_returns_its_p(spark):
    p = registry.queries()["g7_class_by_batch_permuted"](spark, SF.replace("0.001", "0.01")).first().p
    assert 1 / 200 <= p <= 1 and abs(p * 200 - round(p * 200)) < 1e-6
