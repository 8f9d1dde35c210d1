"""Scorers: weighted words (two forms), learned weights, a trained classifier, any Python model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textwarden import config
from textwarden.functions import score as S
from textwarden.functions import text as X
from textwarden.functions.language import keep
from textwarden.util import bounded_batches, broadcast_share, materialise, scratch_dir, settle

MAX_LITERAL_WORDS = 5_000
"""Vocabulary up to which weights travel inside the query; larger ones are joined."""


def score_columns(
    df: DataFrame,
    text: str = "text",
    *,
    model: config.LinearModel = config.DEFAULT_MODEL,
    max_tokens: int | None = None,
    prefix: str = "score_",
    activation: Callable[[Column], Column] = S.sigmoid,
) -> DataFrame:
    """Add one unrounded score column per label, computed inside the row.

    No join and no shuffle, so it works the same on a stream. The whole text counts unless
    ``max_tokens`` asks for a model's token limit. ``activation`` turns a logit into a score.
    """
    vocabulary = model.vocabulary
    if len(vocabulary) > MAX_LITERAL_WORDS:
        raise ValueError(f"more than {MAX_LITERAL_WORDS} words: use score_by_join")
    words = X.pieces(F.col(text)) if max_tokens is None else X.tokens(F.col(text), max_tokens)
    out = df.withColumn("_tokens", words)
    out = out.withColumn("_hits", keep("_tokens", vocabulary))
    logits = S.label_logits("_hits", model)
    scores = {prefix + label: activation(logit) for label, logit in logits.items()}
    return settle(out.withColumns(scores).drop("_tokens", "_hits"), *scores)


def weight_table(spark, model: config.LinearModel = config.DEFAULT_MODEL) -> DataFrame:
    """A model's weights as rows: ``label, tok, w_milli``."""
    rows = [(label, tok, w) for label, words in model.weights.items() for tok, w in words.items()]
    return spark.createDataFrame(rows, "label string, tok string, w_milli int")


def score_by_join(
    df: DataFrame,
    weights: DataFrame,
    bias: dict[str, int],
    *,
    key: str,
    text: str = "text",
    max_tokens: int | None = None,
    prefix: str = "score_",
) -> DataFrame:
    """Scores by joining tokens with a weight table of any size: ``key, score_<label>``.

    Weights are turned to one row per word first, and written out, so that their size is known
    (:func:`weighted_sums` picks the join by it). ``weights`` may have a column ``seen`` that tells how often a
    token was seen. Texts without any weighted token have a score too.
    """
    labels = list(bias)
    seen = [F.max("seen").alias("seen")] if "seen" in weights.columns else []
    wide = weights.groupBy("tok").agg(
        *[
            F.sum(F.when(F.col("label") == label, F.col("w_milli"))).alias(f"_w_{label}")
            for label in labels
        ],
        *seen,
    )
    values = {f"_x_{label}": F.col(f"_w_{label}") for label in labels}
    sums = weighted_sums(df, materialise(wide), values, [key], text, max_tokens)
    return sums.select(
        key,
        *[
            S.sigmoid((F.col(f"_x_{label}") + bias[label]) / 1000.0).alias(prefix + label)
            for label in labels
        ],
    )


def weighted_sums(
    df: DataFrame,
    wide: DataFrame,
    values: Mapping[str, Column],
    keys: Sequence[str],
    text: str = "text",
    max_tokens: int | None = None,
) -> DataFrame:
    """Sums over each text's tokens of ``values``, which read the columns of ``wide(tok, ...)`` and of ``keys``.

    A table small enough by its measured bytes is broadcast: sums are then formed where the texts lie, and one
    row per text is shuffled. Of a larger one the most used words are broadcast, as many as the session's limit
    takes, and only a text's rarer words, equal ones counted before, meet their weights by a shuffle; Spark
    splits a word that most texts share. How often a word is used tells the column ``seen``; without it
    the words of the texts are counted. Missing weights count as 0; texts without tokens have sums of 0.
    """
    words = X.tokens(F.col(text), max_tokens)
    rows = df.select(*keys, F.explode_outer(words).alias("tok"))
    zero = F.lit(0).cast("bigint")
    weighed = {name: F.coalesce(value, zero) for name, value in values.items()}
    if broadcast_share(wide) >= 1:
        sums = [F.sum(value).alias(name) for name, value in weighed.items()]
        return rows.join(F.broadcast(wide), "tok", "left").groupBy(*keys).agg(*sums)
    if "seen" not in wide.columns:
        counts = df.select(F.explode(words).alias("tok")).groupBy("tok").agg(F.count("*").alias("seen"))
        wide = materialise(wide.join(counts, "tok"))
    common = F.col("seen") >= _least_use(wide)
    # one row per text with the sums of its common words, and one for each of its rarer words
    met = rows.join(F.broadcast(wide.where(common).withColumn("_met", F.lit(True))), "tok", "left")
    rarer = F.when(F.col("_met").isNull(), F.col("tok")).alias("tok")
    part = met.groupBy(*keys, rarer).agg(
        F.count("*").alias("_n"), *[F.sum(value).alias(f"_part_{name}") for name, value in weighed.items()]
    )
    # rows without a word get one that no text holds, many of them, or they would all meet in one task
    nothing = F.concat(F.lit(" "), F.pmod(F.xxhash64(*keys), F.lit(10_007)).cast("string"))
    part = part.withColumn("tok", F.coalesce("tok", nothing))
    sums = [F.sum(F.col(f"_part_{name}") + F.col("_n") * value).alias(name) for name, value in weighed.items()]
    return part.join(wide.where(~common), "tok", "left").groupBy(*keys).agg(*sums)


def _least_use(wide: DataFrame) -> int:
    """The least ``seen`` of the words of a written table that are broadcast together: those used most, no more
    than the session's limit takes. Words are counted by the logarithm of their use, some hundred rows."""
    step = F.ceil(F.log2(F.greatest("seen", F.lit(1))) * 8).alias("step")
    steps = wide.groupBy(step).agg(F.count("*").alias("n"), F.min("seen").alias("least"), F.max("seen").alias("most"))
    found = sorted(steps.collect(), key=lambda row: -row["step"])
    room = broadcast_share(wide) * sum(row["n"] for row in found)
    least = found[0]["most"] + 1 if found else 1
    for row in found:
        room -= row["n"]
        if room < 0:
            break
        least = row["least"]
    return least


def token_stats(df: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Token counts per group: ``avg_tokens, min_tokens, max_tokens``."""
    return (
        df.select(by, F.size(X.tokens(F.col(text))).cast("bigint").alias("_n"))
        .groupBy(by)
        .agg(
            F.count("*").alias("n_texts"),
            F.round(F.avg("_n"), 4).alias("avg_tokens"),
            F.min("_n").alias("min_tokens"),
            F.max("_n").alias("max_tokens"),
        )
    )


def token_weights(
    df: DataFrame, text: str = "text", truth: str = "expected", min_docs: int = 5
) -> DataFrame:
    """Smoothed log-odds of every token: ``tok, n_toxic, n_clean, w_milli``.

    A token counts once per text. The class sizes enter as a scalar subquery,
    not as a join.
    """
    seen = df.select(truth, F.explode(F.array_distinct(X.tokens(F.col(text)))).alias("tok"))
    per_token = (
        seen.groupBy("tok")
        .agg(
            F.count_if(F.col(truth) == 1).alias("n_toxic"),
            F.count_if(F.col(truth) == 0).alias("n_clean"),
        )
        .where(F.col("n_toxic") + F.col("n_clean") >= min_docs)
    )

    totals = df.select(
        F.struct(
            F.count_if(F.col(truth) == 1).alias("toxic"), F.count_if(F.col(truth) == 0).alias("clean")
        )
    ).scalar()
    toxic_odds = (F.col("n_toxic") + 0.5) / (totals["toxic"] - F.col("n_toxic") + 0.5)
    clean_odds = (F.col("n_clean") + 0.5) / (totals["clean"] - F.col("n_clean") + 0.5)
    weight = F.round(F.ln(toxic_odds / clean_odds) * 1000).cast("bigint")
    return per_token.withColumn("w_milli", weight)


def learn_weights(
    df: DataFrame,
    text: str = "text",
    truth: str = "expected",
    *,
    min_docs: int = 5,
    scale: float = 0.5,
) -> DataFrame:
    """A keyword model as a weight table: every token's log-odds, both signs, for both labels.

    The table is as long as the vocabulary and goes to :func:`score_by_join`.
    """
    weight = (F.col("w_milli") * F.lit(scale)).cast("bigint")
    return _both_labels(token_weights(df, text, truth, min_docs).select("tok", weight.alias("w_milli")))


def _both_labels(weights: DataFrame) -> DataFrame:
    """``tok, w_milli, ...`` of the toxic label -> ``label, tok, w_milli, ...`` of it and its opposite."""
    pair = F.array(
        F.struct(F.lit("toxic").alias("label"), F.col("w_milli")),
        F.struct(F.lit("not_toxic").alias("label"), (-F.col("w_milli")).alias("w_milli")),
    )
    more = [name for name in weights.columns if name not in ("tok", "w_milli")]
    return weights.select("tok", *more, F.inline(pair)).select("label", "tok", "w_milli", *more)


def naive_bayes(
    df: DataFrame, text: str = "text", truth: str = "expected"
) -> tuple[DataFrame, dict[str, int]]:
    """Multinomial naive Bayes in closed form: ``(weights, bias)`` for :func:`score_by_join`.

    A token's weight is the logarithm of the ratio of its smoothed shares of all toxic and all clean
    tokens, in thousandths; all tokens have one, and ``seen`` tells how often the texts hold it. The bias is the logarithm of the ratio of
    the classes' texts (each counted once more than it is), and the only thing collected.
    Tokens that no training text has do not count.
    """
    toxic, clean = F.count_if(F.col(truth) == 1), F.count_if(F.col(truth) == 0)
    tokens = df.select(truth, F.explode(X.tokens(F.col(text))).alias("tok"))
    counted = materialise(tokens.groupBy("tok").agg(toxic.alias("n_toxic"), clean.alias("n_clean")))
    totals = counted.agg(F.sum("n_toxic").alias("toxic"), F.sum("n_clean").alias("clean"), F.count("*").alias("size"))
    total = totals.select(F.struct("toxic", "clean", "size")).scalar()
    shares = ((F.col("n_toxic") + 1.0) / (total["toxic"] + total["size"])) / (
        (F.col("n_clean") + 1.0) / (total["clean"] + total["size"])
    )
    seen = (F.col("n_toxic") + F.col("n_clean")).alias("seen")
    weights = counted.select("tok", F.round(F.ln(shares) * 1000).cast("bigint").alias("w_milli"), seen)
    row = df.agg(F.round(F.ln((toxic + 1.0) / (clean + 1.0)) * 1000).cast("bigint").alias("bias")).first()
    return _both_labels(weights), {"toxic": int(row["bias"]), "not_toxic": -int(row["bias"])}


def naive_bayes_folds(
    df: DataFrame, fold: str, folds: int, text: str = "text", truth: str = "expected"
) -> tuple[DataFrame, list[int]]:
    """:func:`naive_bayes` without each fold in turn: ``(tok, w_milli, seen)`` with an array of one weight per fold
    and how often all texts hold the token, and the biases.

    Tokens are counted once, by fold; what a fold is not fitted on is the total less its own counts. A weight
    is null where only the fold itself has the token. One row of totals is collected.
    """
    toxic = F.col(truth) == 1
    own = [F.col(fold) == i for i in range(folds)]
    tokens = df.select(truth, fold, F.explode(X.tokens(F.col(text))).alias("tok"))
    counted = materialise(
        tokens.groupBy("tok").agg(
            F.array(*[F.count_if(toxic & mine) for mine in own]).alias("_pos"),
            F.array(*[F.count_if(~toxic & mine) for mine in own]).alias("_neg"),
        )
    )

    def others(name: str, i: int) -> Column:
        return F.aggregate(name, F.lit(0).cast("bigint"), lambda acc, x: acc + x) - F.col(name)[i]

    sums = [
        column
        for i in range(folds)
        for column in (
            F.sum(others("_pos", i)).alias(f"pos{i}"),
            F.sum(others("_neg", i)).alias(f"neg{i}"),
            F.count_if(others("_pos", i) + others("_neg", i) > 0).alias(f"size{i}"),
        )
    ]
    total = counted.agg(*sums).first().asDict()
    weights = []
    for i in range(folds):
        pos, neg, size = (total[f"{name}{i}"] or 0 for name in ("pos", "neg", "size"))
        if not size:
            weights.append(F.lit(None).cast("bigint"))
            continue
        shares = ((others("_pos", i) + 1.0) / F.lit(pos + size)) / ((others("_neg", i) + 1.0) / F.lit(neg + size))
        seen = others("_pos", i) + others("_neg", i) > 0
        weights.append(F.when(seen, F.round(F.ln(shares) * 1000).cast("bigint")))
    # texts of the other folds by class, each counted once more
    texts = [
        F.round(F.ln((F.count_if(toxic & ~mine) + 1.0) / (F.count_if(~toxic & ~mine) + 1.0)) * 1000).cast("bigint").alias(f"b{i}")
        for i, mine in enumerate(own)
    ]
    row = df.agg(*texts).first()
    add = lambda name: F.aggregate(name, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    seen = (add("_pos") + add("_neg")).alias("seen")
    return counted.select("tok", F.array(*weights).alias("w_milli"), seen), [int(row[f"b{i}"]) for i in range(folds)]


def oof_scores(
    df: DataFrame,
    fold: str,
    folds: int,
    keep: Sequence[str],
    text: str = "text",
    truth: str = "expected",
) -> DataFrame:
    """Every labelled text under naive Bayes fitted on the other folds: ``keep``, ``fold`` and ``score``.

    ``fold`` holds 0 to ``folds - 1``; ``keep`` names columns that tell the rows apart. All folds are fitted and
    scored in one pass each, so figures on these scores are held-out figures of all labelled texts.
    """
    if folds < 2:
        raise ValueError("held-out scores need two folds or more")
    weights, bias = naive_bayes_folds(df, fold, folds, text, truth)
    value = {"_x": F.get("w_milli", F.col(fold))}
    sums = weighted_sums(df, materialise(weights), value, [*keep, fold], text)
    own = F.get(F.array(*map(F.lit, bias)), F.col(fold))
    return sums.select(*keep, fold, S.sigmoid((F.col("_x") + own) / 1000.0).alias("score"))


def train_classifier(
    df: DataFrame,
    text: str = "text",
    truth: str = "expected",
    features: int = 1 << 18,
    max_iter: int = 100,
):
    """Fit Spark ML: the library's tokens, hashed term counts, IDF and logistic regression.

    Tokens that fall into one of the ``features`` buckets share a weight; ``max_iter`` bounds the
    iterations of the fit.

    The model is saved to the scratch folder and loaded from there: a fitted one drags its
    training summary, session included, into every task, which Spark cannot always serialise.
    """
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF

    stages = [
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(
            featuresCol="_features", labelCol="_label", maxIter=max_iter, regParam=0.1, elasticNetParam=0.0
        ),
    ]
    rows = df.select(
        X.tokens(F.col(text)).alias("_tokens"), F.col(truth).cast("double").alias("_label")
    )
    path = scratch_dir(df.sparkSession)
    Pipeline(stages=stages).fit(rows).write().save(path)
    return PipelineModel.load(path)


def trained_scores(df: DataFrame, fitted, text: str = "text", out: str = "score_toxic") -> DataFrame:
    """Add the probability of the toxic class under a fitted classifier."""
    from pyspark.ml.functions import vector_to_array

    scored = fitted.transform(df.withColumn("_tokens", X.tokens(F.col(text))))
    probability = vector_to_array(F.col("probability"))
    done = scored.withColumn(out, probability[1]).drop(
        "_tokens", "_tf", "_features", "rawPrediction", "probability", "prediction"
    )
    return settle(done, out)


Predictor = Callable[[pd.Series], pd.DataFrame]


def model_scores(
    df: DataFrame,
    factory: Callable[[], Predictor],
    labels: Sequence[str],
    text: str = "text",
    prefix: str = "score_",
) -> DataFrame:
    """Add scores of a caller's own model, plus ``error`` for rows it failed on.

    ``factory`` runs once per task and returns a function from a series of texts to a frame
    with one column per label. Only the text travels to Python and only the scores come back;
    blank and missing texts are never sent to the model and get null scores. A batch has some megabytes of
    texts (a longer text has one to itself) and is freed before the next one, so what a worker holds does not grow
    with the rows of its task.
    """
    bounded_batches(df.sparkSession)
    labels = list(labels)
    schema = T.StructType(
        [T.StructField(label, T.DoubleType()) for label in labels]
        + [T.StructField("error", T.StringType())]
    )

    # Both functions are local, so that they are sent to the workers whole and a worker need
    # not have this package installed.
    def one_by_one(predict: Predictor, texts: pd.Series) -> pd.DataFrame:
        """After a failed batch: an error stays with its own row."""
        rows = []
        for text in texts:
            try:
                row = predict(pd.Series([text])).iloc[0]
                rows.append({**{label: float(row[label]) for label in labels}, "error": None})
            except Exception as problem:
                rows.append({"error": f"{type(problem).__name__}: {problem}"})
        return pd.DataFrame(rows, index=texts.index, columns=[*labels, "error"])

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import gc

        predict = factory()
        for texts in batches:
            result = pd.DataFrame(index=texts.index, columns=[*labels, "error"], dtype=object)
            chosen = texts[texts.notna() & (texts.str.strip() != "")]
            if len(chosen):
                try:
                    rows = predict(chosen)[labels].set_axis(chosen.index, axis=0).assign(error=None)
                except Exception:
                    rows = one_by_one(predict, chosen)
                result.loc[chosen.index] = rows
            result[labels] = result[labels].astype("float64")
            result["error"] = result["error"].where(result["error"].notna(), None)
            yield result
            # a series that was asked for ``.str`` refers to itself: it stays until the cycles are looked for, which
            # so few objects do not bring about
            del texts, chosen, result
            gc.collect()

    out = settle(df.withColumn("_model", run(F.col(text))), "_model")
    columns = {
        prefix + label: F.when(F.isnan(f"_model.{label}"), None).otherwise(F.col(f"_model.{label}"))
        for label in labels
    }
    return out.withColumns({**columns, "error": F.col("_model.error")}).drop("_model")


def scores_long(df: DataFrame, key: str, labels: Sequence[str], prefix: str = "score_") -> DataFrame:
    """Score columns as rows ``key, label, score``."""
    pairs = reduce(lambda acc, label: [*acc, F.lit(label), F.col(prefix + label)], labels, [])
    return df.select(key, F.explode(F.create_map(*pairs)).alias("label", "score"))
