"""Language identification over tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textwarden import config
from textwarden.functions import language as L
from textwarden.functions import text as T
from textwarden.operators.scoring import weighted_sums
from textwarden.util import fits_broadcast, materialise, settle

Profile = Mapping[str, Sequence[str]]


def with_ballot(
    df: DataFrame, text: str, profile: Profile = config.DEFAULT_PROFILE, out: str = "_ballot"
) -> DataFrame:
    """Add the language votes of a text as an array column."""
    return (
        df.withColumn("_tokens", T.pieces(F.col(text)))
        .withColumn("_hits", L.known_tokens("_tokens", L.markers(profile)))
        .withColumn("_script", L.script_votes(F.col(text), "_hits"))
        .withColumn(out, L.ballot("_hits", "_script", profile))
        .drop("_tokens", "_hits", "_script")
    )


def detect_language(
    df: DataFrame,
    text: str = "text",
    *,
    profile: Profile = config.DEFAULT_PROFILE,
    settings: config.Settings = config.DEFAULT_SETTINGS,
    given: str | None = None,
) -> DataFrame:
    """Add ``language_raw`` (best code or ``unknown``) and ``language`` (a supported code).

    ``given`` names a column with a caller-supplied language: where it is set it is taken as
    it is, without mapping, while ``language_raw`` still shows what was detected.
    """
    out = with_ballot(df, text, profile).withColumn("_best", L.leader(F.col("_ballot")))
    out = settle(out.drop("_ballot"), "_best")
    out = out.withColumn("language_raw", L.winner(F.col("_best")))
    detected = L.supported_language(F.col("language_raw"), settings)
    language = detected if given is None else F.coalesce(F.col(given), detected)
    return out.withColumn("language", language).drop("_best")


def detect_with_confidence(
    df: DataFrame,
    text: str = "text",
    *,
    profile: Profile = config.DEFAULT_PROFILE,
    settings: config.Settings = config.DEFAULT_SETTINGS,
) -> DataFrame:
    """Add ``detected_raw``, ``detected_mapped``, ``confidence`` and ``all_candidates``.

    Confidence is a language's share of all votes.
    """
    voted = with_ballot(df, text, profile)
    found = voted.withColumn("all_candidates", L.candidates(F.col("_ballot"), settings))
    return (
        settle(found.drop("_ballot"), "all_candidates")
        .withColumn("_best", F.try_element_at("all_candidates", F.lit(1)))
        .withColumn("detected_raw", F.coalesce(F.col("_best.lang"), F.lit(config.UNKNOWN_LANGUAGE)))
        .withColumn("detected_mapped", L.supported_language(F.col("detected_raw"), settings))
        .withColumn("confidence", F.coalesce(F.col("_best.confidence"), F.lit(0.0)))
        .drop("_ballot", "_best")
    )


def language_table(
    spark: SparkSession, settings: config.Settings = config.DEFAULT_SETTINGS
) -> DataFrame:
    """Supported languages: ``code, name``."""
    return spark.createDataFrame(list(settings.names.items()), "code string, name string")


def alias_table(spark: SparkSession, settings: config.Settings = config.DEFAULT_SETTINGS) -> DataFrame:
    """Aliases with the name of their target: ``alias, maps_to, target_name``."""
    aliases = spark.createDataFrame(list(settings.aliases.items()), "alias string, maps_to string")
    names = F.broadcast(language_table(spark, settings))  # as many rows as Settings.names
    return aliases.join(names, aliases.maps_to == names.code, "left").select(
        "alias", "maps_to", F.coalesce("name", F.lit("Unknown")).alias("target_name")
    )


def threshold_table(
    spark: SparkSession, settings: config.Settings = config.DEFAULT_SETTINGS
) -> DataFrame:
    """Threshold of every code that has one, aliases included: ``code, threshold``."""
    rows = {code: float(value) for code, value in settings.thresholds.items()}
    for alias, target in settings.aliases.items():
        if target in settings.thresholds:
            rows[alias] = float(settings.thresholds[target])
    return spark.createDataFrame(list(rows.items()), "code string, threshold double")


def lookup_threshold(
    df: DataFrame, language: str, settings: config.Settings = config.DEFAULT_SETTINGS
) -> DataFrame:
    """Add ``threshold`` by joining the threshold table (sized by the settings) on a language column."""
    table = F.broadcast(threshold_table(df.sparkSession, settings))
    joined = df.join(table, F.col(language) == table.code, "left").drop("code")
    return joined.withColumn(
        "threshold", F.coalesce("threshold", F.lit(float(settings.default_threshold)))
    )


def learn_profile(
    df: DataFrame, text: str = "text", lang: str = "lang", top: int = 15, min_docs: int = 1
) -> DataFrame:
    """Most frequent tokens per language, without tokens ranked in all languages: ``lang, tok, n, rank``.

    Word counts are summed map-side. The ``rank <= top`` filter lets Spark keep only each
    task's best tokens before the shuffle (for as many ranks as
    ``spark.sql.optimizer.windowGroupLimitThreshold`` says), so the size of a language does not
    matter. ``min_docs`` counts the texts that hold a token.
    """
    tokens = T.tokens(F.col(text))
    one = F.lit(1).cast("bigint")
    rows = df.select(lang, F.explode(tokens).alias("tok"), one.alias("_n"), (one * 0).alias("_d"))
    if min_docs > 1:
        rows = rows.union(df.select(lang, F.explode(F.array_distinct(tokens)), one * 0, one))
    counts = rows.groupBy(lang, "tok").agg(F.sum("_n").alias("n"), F.sum("_d").alias("_d"))
    if min_docs > 1:
        counts = counts.where(F.col("_d") >= min_docs)
    counts = counts.drop("_d")
    order = Window.partitionBy(lang).orderBy(F.desc("n"), "tok")
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    # From here on there are at most ``top`` rows per language.
    languages = df.select(F.count_distinct(lang)).scalar()
    shared_by = F.count("*").over(Window.partitionBy("tok"))
    return (
        ranked.withColumn("_shared_by", shared_by)
        .where(F.col("_shared_by") < F.greatest(languages, F.lit(2)))
        .select(F.col(lang).alias("lang"), "tok", "n", F.col("rank").cast("bigint").alias("rank"))
    )


GRAM = 3


def _grams(tok: Column) -> Column:
    """Character n-grams of a token between blanks."""
    padded = F.concat(F.lit(" "), tok, F.lit(" "))
    last = F.length(padded) - (GRAM - 1)
    return F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(padded, i, F.lit(GRAM)))


def learn_grams(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Character n-grams of every language as a table of weights: ``gram, lang, w_milli``.

    A weight is the logarithm, in thousandths, of the n-gram's smoothed share in the language, and
    every n-gram has one for every language. Tokens are counted before they are cut up, so a word
    is cut once for each language, however frequent it is. The counts of n-grams are written out: the sizes of the
    languages and the weights read them, the texts are read once.
    """
    tokens = df.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(T.tokens(F.col(text))).alias("tok"))
    words = tokens.groupBy("lang", "tok").agg(F.count("*").alias("n"))
    counts = materialise(
        words.select("lang", "n", F.explode(_grams(F.col("tok"))).alias("gram"))
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    size = counts.select(F.count_distinct("gram")).scalar()
    per_gram = counts.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang"))
    languages = totals.agg(F.sort_array(F.collect_list(F.struct("lang", "total")))).scalar()
    n = F.coalesce(F.try_element_at("by_lang", F.col("lang")), F.lit(0))
    return per_gram.select("gram", "by_lang", F.inline(languages)).select(
        "gram", "lang", F.round(F.ln((n + 1.0) / (F.col("total") + size)) * 1000).cast("bigint").alias("w_milli")
    )


def detect_learned(df: DataFrame, grams: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Language by learned n-grams: ``key, detected, confidence, all_candidates``.

    Every distinct word is cut up and weighed once, for all languages together, beside the n-grams if their table is
    small enough for a broadcast; texts meet the words' weights as in :func:`weighted_sums`. The languages' codes
    are collected. ``all_candidates`` has all languages, best first, with their posterior probability
    (equal priors, four digits); ties go to the alphabetically first code. Texts without a known
    n-gram are ``unknown`` with confidence 0.
    """
    codes = [row["lang"] for row in grams.select("lang").distinct().orderBy("lang").collect()]
    if not codes:
        none = F.lit(None).cast("array<struct<lang: string, confidence: double>>")
        return df.select(
            key, F.lit(config.UNKNOWN_LANGUAGE).alias("detected"), F.lit(0.0).alias("confidence"), none.alias("all_candidates")
        )
    weight = [F.sum(F.when(F.col("lang") == code, F.col("w_milli"))).alias(f"_w{i}") for i, code in enumerate(codes)]
    by_gram = materialise(grams.groupBy("gram").agg(*weight))
    by_gram = F.broadcast(by_gram) if fits_broadcast(by_gram) else by_gram
    words = df.select(F.explode(T.tokens(F.col(text))).alias("tok")).groupBy("tok").agg(F.count("*").alias("seen"))
    pieces = words.select("tok", "seen", F.explode(_grams(F.col("tok"))).alias("gram")).join(by_gram, "gram")
    names = [f"_w{i}" for i in range(len(codes))]
    by_word = pieces.groupBy("tok").agg(F.max("seen").alias("seen"), *[F.sum(name).alias(name) for name in names])
    values = {name: F.col(name) for name in names} | {"_known": F.when(F.col(names[0]).isNotNull(), F.lit(1))}
    sums = weighted_sums(df, materialise(by_word), values, [key], text)
    ranks = [F.struct((-F.col(name)).alias("rank"), F.lit(code).alias("lang")) for name, code in zip(names, codes)]
    found = sums.select(key, F.when(F.col("_known") > 0, F.sort_array(F.array(*ranks))).alias("_r"))
    odds = F.transform("_r", lambda r: F.exp((F.col("_r")[0]["rank"] - r["rank"]) / 1000.0))
    total = F.aggregate("_odds", F.lit(0.0), lambda a, x: a + x)
    found = found.withColumn("_odds", odds).withColumn(
        "all_candidates",
        F.zip_with("_r", "_odds", lambda r, o: F.struct(r["lang"].alias("lang"), F.round(o / total, 4).alias("confidence"))),
    )
    best = F.col("all_candidates")[0]
    return found.select(
        key,
        F.coalesce(best["lang"], F.lit(config.UNKNOWN_LANGUAGE)).alias("detected"),
        F.coalesce(best["confidence"], F.lit(0.0)).alias("confidence"),
        "all_candidates",
    )


def confusion_by_language(df: DataFrame, declared: str, detected: str, codes: Sequence[str]) -> DataFrame:
    """Declared language against detected language: one row per declared, one column per code."""
    return df.groupBy(declared).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col(detected) == code).alias(f"as_{code}") for code in codes],
        F.round(F.avg((F.col(declared) == F.col(detected)).cast("double")), 4).alias("agreement"),
    )
