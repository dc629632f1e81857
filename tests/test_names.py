"""Column names with dots, backticks and quotes, and such a key, through every public entry."""

import pytest
from pyspark.sql import functions as F

from gapfill.frames import (check_key, col, column_kinds, count_missing, kinds_table, missing_mask, missing_profile, pair_frames,
                            preserve_observed)
from gapfill.operators.ampute import PatternConfig, ampute, introduce_missing
from gapfill.operators.encode import (TabularPreprocessor, onehot_encode, ordinal_encode, shuffle, split, swap_noise, union_encode)
from gapfill.operators.impute.chained import MICEImputer, MissForestImputer, XGBoostImputer
from gapfill.operators.impute.completion import CompletionImputer
from gapfill.operators.impute.knn import KNNImputer
from gapfill.operators.impute.neural import DAEImputer
from gapfill.operators.impute.statistical import StatisticalImputer
from gapfill.operators.metrics.predictive import predictive_comparison
from gapfill.plans.evaluate import evaluate
from gapfill.functions.jsontext import completion_prompts, decode_rows, encode_rows, longest_text, shuffled_rows

KEY, A, B, C = "k.`1", "a.b", "c`d", "e'f"


@pytest.fixture(scope="module")
def true(spark):
    rows = [(i, float(i), float(3 * i + i % 7), "xyz"[i % 3]) for i in range(90)]
    return spark.createDataFrame(rows, "k long, a double, b double, c string").toDF(KEY, A, B, C).persist()


@pytest.fixture(scope="module")
def holed(true):
    return ampute(true, KEY, 0.3, [PatternConfig([A], "MAR"), PatternConfig([C], "MNAR")], seed=1, check=False).select(
        *[col(c) for c in (KEY, A, B, C)]).persist()


def echo():
    """Answers 7 or x; made inside a function, so that it travels to the workers by value."""
    number = f'"{A}":'

    def run(batches):
        for pdf in batches:
            yield pdf["prompt"] + pdf["prompt"].str.endswith(number).map({True: "7}", False: '"x"}'})
    return run


IMPUTERS = {
    "mean": lambda: StatisticalImputer("mean"), "median": lambda: StatisticalImputer("median"),
    "knn": lambda: KNNImputer(), "knn_boxes": lambda: KNNImputer(max_broadcast_bytes=0), "knn_ordinal": lambda: KNNImputer(categorical_encoder="ordinal"),
    "mice": lambda: MICEImputer(max_iter=2), "mice_ordinal": lambda: MICEImputer(max_iter=2, categorical_encoder="ordinal"),
    "forest": lambda: MissForestImputer(n_estimators=3, max_iter=1, max_depth=3),
    "forest_dummies": lambda: MissForestImputer(n_estimators=3, max_iter=1, max_depth=3, categorical_encoder="onehot"),
    "boosting": lambda: XGBoostImputer(n_estimators=3, max_iter=1), "dae": lambda: DAEImputer(rounds=1, local_epochs=1, hidden_dim=8, latent_dim=4),
    "completion": lambda: CompletionImputer(echo())}


@pytest.mark.parametrize("name", IMPUTERS)
def test_imputers(holed, name):
    out = IMPUTERS[name]().fit_transform(holed, KEY)
    assert out.columns == holed.columns and out.count() == 90
    assert count_missing(out, [A, B, C])["*"] == 0


def test_evaluate(true, holed):
    filled = StatisticalImputer("mean").fit_transform(holed, KEY)
    res = evaluate(X=true, X_imputed=filled, X_missing=holed, key=KEY)
    found = res.to_dict()
    assert set(found["reconstruction"]["mae"]) == {A, "avg"} and found["reconstruction"]["categorical_accuracy"][C] is not None
    res = evaluate(X=true, X_imputed=filled, missing_mask=missing_mask(holed, KEY), X_missing=holed, key=KEY, y=true.select(col(KEY), col(C).alias("t.y")),
                   target="t.y", n_folds=2, max_iter=2, columns=[A, B])
    assert res.overall_score is not None
    out = predictive_comparison(true, filled, true, KEY, B, [A, C], n_folds=2, max_iter=2)
    assert out.count() == 8


def test_frames(true, holed):
    check_key(true, KEY)
    assert list(column_kinds(true, KEY)) == [A, B, C] and kinds_table(true, KEY).count() == 3
    assert missing_profile(holed, [A, B, C]).count() == 5
    assert pair_frames(true, holed, KEY, [A, C], missing=holed).count() == 90
    assert count_missing(preserve_observed(holed, {A: F.lit(1.0)}), [A])["*"] == 0


def test_encoders(true, holed):
    assert onehot_encode(holed, C).columns == [KEY, A, B, *(f"{C}={v}" for v in "xyz")]
    assert [r[0] for r in ordinal_encode(true, C).select(col(C)).distinct().orderBy(col(C)).collect()] == [0.0, 1.0, 2.0]
    assert len(union_encode([true, holed], [C, B])) == 2
    prep = TabularPreprocessor().fit(holed, KEY)
    back = prep.inverse_transform(prep.transform(holed, KEY), KEY)
    assert back.columns == [KEY, A, B, C] and back.where(col(C).isNull()).count() == 0
    assert swap_noise(true, KEY, [A, C], 0.5).where(col(f"{A}__swapped")).count() > 10
    assert shuffle(true, KEY).count() == split(true, KEY, 0.2, exact=True).count() == 90


def test_injection(true):
    for patterns in (None, [PatternConfig([A], "MAR"), PatternConfig([C], "MNAR")], [PatternConfig([B], "MAR+MNAR", weights={A: 1.0, B: 0.5})]):
        table, mask = introduce_missing(true, key=KEY, proportion=0.4, patterns=patterns, seed=3)
        assert table.columns == true.columns and mask.count() == 90 and count_missing(table, [A, B, C])["*"] > 10


def test_text(true, holed):
    text = encode_rows(true, [A, C]).select(col(KEY), "text")
    schema = true.select(col(A), col(C)).schema
    assert decode_rows(text, "text", schema).where(col(A) == 3.0).count() == 1
    assert shuffled_rows(true, KEY, [A, C], epochs=2).count() == 180 and longest_text(true, [A, C]).first()[0] > 5
    assert completion_prompts(holed, KEY, [A, C]).count() > 10
