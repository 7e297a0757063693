"""Text classifier training and scoring on Spark ML.

The reference retrains a BERT+BiLSTM network with PyTorch; neither the
network weights nor the tokenizer are in the repository, so the model is
re-aimed at a distributed Spark ML pipeline with the same contract:
``clean_text, Label`` in, a 2-class ``label`` / ``confidence`` out. The epochs
(M3) are in ``operators.sgd``.

* tokens: letters only (``[^\\p{L}]+`` splits), lower-cased;
* features: binary bag of words with a document-frequency floor;
* model: logistic regression, elastic net, positive class re-weighted by
  the class ratio (few positives in moderation data).

Everything is a Spark ML stage: fitting runs as distributed aggregations
(vocabulary counts, one tree-aggregate per optimiser step); scoring is a
projection.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import LABEL_CLEAN, LABEL_TOXIC
from vigil.operators.classify import Scorer
from vigil.operators.trainlog import EPOCHS

TOKEN_PATTERN = r"[^\p{L}]+"
MIN_DF = 5.0
REG_PARAM = 0.1
ELASTIC_NET = 0.5
ITERS_PER_EPOCH = 10
VAL_BUCKETS = 5  # one fifth of the texts (by a seeded hash) is held out


def split_train_val(df: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Deterministic split by a seeded hash of the text (repeatable across layouts)."""
    h = F.pmod(F.xxhash64(F.col("clean_text"), F.lit(seed)), F.lit(VAL_BUCKETS))
    return df.where(h != 0), df.where(h == 0)


# The most frequent terms of the training set that the bag of words keeps; the list of terms and
# one weight each come to the driver, so this bounds its memory.
VOCAB_SIZE = 1 << 18


def _weighted(df: DataFrame) -> DataFrame:
    """Weight positives by ``n_neg / n_pos`` (a scalar subquery, no collect)."""
    ratio = df.select(
        (F.count_if(F.col("y") == 0) / F.greatest(F.count_if(F.col("y") == 1), F.lit(1))).cast("double")
    ).scalar()
    return df.withColumn("w", F.when(F.col("y") == 1, ratio).otherwise(F.lit(1.0)))


def pipeline(max_iter: int, vocab_size: int = VOCAB_SIZE) -> Pipeline:
    """Tokenizer, bag of words over the ``vocab_size`` most frequent terms, logistic regression."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="clean_text", outputCol="tokens", pattern=TOKEN_PATTERN, toLowercase=True),
            CountVectorizer(inputCol="tokens", outputCol="features", minDF=MIN_DF, vocabSize=vocab_size, binary=True),
            LogisticRegression(
                featuresCol="features", labelCol="y", weightCol="w", maxIter=max_iter,
                regParam=REG_PARAM, elasticNetParam=ELASTIC_NET, family="binomial",
            ),
        ]
    )


def _prepare(df: DataFrame) -> DataFrame:
    """``clean_text, y, truth``: ``Label`` is renamed because Spark names are
    case-insensitive and the scored ``label`` would replace it (Q13)."""
    kept = df.where(F.col("clean_text").isNotNull() & F.col("Label").isNotNull())
    return kept.select("clean_text", F.col("Label").cast("double").alias("y"), F.col("Label").cast("int").alias("truth"))


def train(train_df: DataFrame, max_iter: int = EPOCHS * ITERS_PER_EPOCH) -> PipelineModel:
    """Fit the text classifier on ``clean_text, Label``."""
    data = _weighted(_prepare(train_df))
    if data.isEmpty():  # Q19: the reference divides by zero on an empty set
        raise ValueError("empty training set")
    return pipeline(max_iter).fit(data)


def score(model: PipelineModel, df: DataFrame, text_col: str = "clean_text") -> DataFrame:
    """Add ``pred`` (argmax, a tie goes to class 0), ``label`` and ``confidence``.

    ``df`` must not carry a column named ``label`` in any case (it is replaced).
    """
    df = df.withColumnRenamed(text_col, "clean_text") if text_col != "clean_text" else df
    # A null text is scored like an empty one and comes out null.
    filled = df.withColumn("_null", F.col("clean_text").isNull()).withColumn("clean_text", F.coalesce("clean_text", F.lit("")))
    scored = model.transform(filled).withColumn("clean_text", F.when(~F.col("_null"), F.col("clean_text"))).drop("_null")
    p = vector_to_array(F.col("probability"))
    pred = F.when(p[1] > p[0], F.lit(1)).otherwise(F.lit(0))
    out = scored.withColumns(
        {
            "pred": pred,
            "label": F.when(pred == 1, F.lit(LABEL_TOXIC)).otherwise(F.lit(LABEL_CLEAN)),
            "confidence": F.greatest(p[0], p[1]),
            "p1": p[1],
        }
    )
    return out.drop("tokens", "features", "rawPrediction", "probability", "prediction")


def model_scorer(model: PipelineModel) -> Scorer:
    """A fitted model as a scorer for the gate, the page scan and the queue; columns come back as they were.

    ``df`` holds ``text`` and no column named as one of the model's (``clean_text``, ``tokens``, ``features``, ...).
    """

    def scorer(df: DataFrame) -> DataFrame:
        return score(model, df, "text").withColumnRenamed("clean_text", "text").select(*df.columns, "label", "confidence")

    return scorer


# --- R6: the classifier head on ready-made vectors -------------------------------


def embedding_head(vectors: DataFrame, positive: F.Column, max_iter: int = 50) -> tuple[PipelineModel, DataFrame]:
    """Logistic regression on ``embedding ARRAY<FLOAT>`` with a binary target; returns model + scored rows.

    Every row is scored; the fit does not see the fifth of the rows (by a hash of ``vec_id``) marked ``held_out``.
    """
    data = vectors.select(
        "vec_id", array_to_vector(F.col("embedding")).alias("features"), positive.cast("double").alias("y"),
        (F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0).alias("held_out"),
    )
    lr = LogisticRegression(featuresCol="features", labelCol="y", maxIter=max_iter, regParam=0.01)
    model = Pipeline(stages=[lr]).fit(data.where("NOT held_out"))
    p = vector_to_array(F.col("probability"))
    scored = model.transform(data).select(
        "vec_id",
        "held_out",
        F.col("y").cast("int").alias("truth"),
        F.when(p[1] > p[0], 1).otherwise(0).alias("pred"),
        F.greatest(p[0], p[1]).alias("confidence"),
    )
    return model, scored
