"""Text classifier (M1, M2): null texts, the empty set, the vocabulary bound."""

import pytest

from vigil.operators import train as Tr


def test_null_and_repeated_texts_are_scored(spark):
    rows = [(f"good day number{k % 3}", 0) for k in range(20)] + [(f"you idiot number{k % 3}", 1) for k in range(20)] + [(None, 1)]
    df = spark.createDataFrame(rows, "clean_text string, Label int")
    model = Tr.train(df, max_iter=5)
    out = Tr.score(model, df.withColumnRenamed("Label", "truth")).select("clean_text", "truth", "pred", "confidence").collect()
    assert len(out) == 41 and sum(r.clean_text is None for r in out) == 1
    assert all(r.pred in (0, 1) and 0.5 <= r.confidence <= 1 for r in out)
    assert all(r.pred == r.truth for r in out if r.clean_text is not None)
    with pytest.raises(ValueError):
        Tr.train(df.limit(0))


def test_vocabulary_bound_is_a_parameter():
    assert Tr.pipeline(1).getStages()[1].getVocabSize() == Tr.VOCAB_SIZE
    assert Tr.pipeline(1, vocab_size=7).getStages()[1].getVocabSize() == 7
