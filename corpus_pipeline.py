"""Documents to a training mix: language, near copies, benchmark items, personal data, source weights.

``STAGES`` are functions of (spark, documents so far, folder of the tables); each result is written as
Parquet and read again as the next one's documents. Stages work on any column order and pass further
columns on. Rows without an id are told apart by their text. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.columns import table
from lectern.llm.decontaminate import find_leaks
from lectern.llm.language import UNDETERMINED, fit_language, predict_language
from lectern.llm.mixing import mix_sources
from lectern.llm.near_copies import near_copies
from lectern.llm.pii import find_pii
from lectern.session import pin, scratch_path, small, with_scratch

LEAST_SCORE = 0.2


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that clash with nothing, and the new name of each column."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _key(docs: DataFrame) -> Column:
    """The document's id; for a row without one, a hash of its text."""
    return F.coalesce(docs["doc_id"], F.xxhash64(F.coalesce(docs["text"], F.lit(""))))


def _one_per_key(keyed: DataFrame, repeated: DataFrame) -> DataFrame:
    """``keyed`` with one row of each key in ``repeated``, which is pinned; rows of other keys are not moved if these are few."""
    repeated = small(repeated)
    first = keyed.join(repeated, "__key", "left_semi").dropDuplicates(["__key"])
    return keyed.join(repeated, "__key", "left_anti").unionByName(first)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language cannot be told: no letters, or hardly an n-gram any language knows.

    Three of four documents by checksum of the id train the filters. If none has a language, all stay.
    """
    held = F.coalesce(F.crc32(docs["doc_id"].cast("string")) % 4 == 2, F.lit(True))
    filters = fit_language(docs.where(~held))
    if not filters.languages:
        return docs
    plain, names = _renamed(docs)
    rest = tuple(n for c, n in names.items() if c != "doc_id")
    found = predict_language(plain, filters, names["doc_id"], names["text"], keep=rest)
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col("doc_id" if c == "doc_id" else n).alias(c) for c, n in names.items()])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id stays of each class of near copies; of repeated rows one stays.

    A document is an id with a text: texts that share an id are judged each for itself. Texts without
    words link to nothing, so they stay.
    """
    with_scratch(spark)
    keyed = docs.select("*", _key(docs).alias("__id")).withColumn("__key", F.xxhash64("__id", F.coalesce("text", F.lit(""))))
    found = near_copies(keyed.select(F.col("__key").alias("doc_id"), "text"))
    classes = pin(found.groupBy(F.col("doc_id").alias("__key")).agg(F.min("class_id").alias("class_id"), F.count(F.lit(1)).alias("rows")))
    repeated = pin(classes.where("rows > 1").select("__key"))
    shared = pin(classes.groupBy("class_id").count().where("count > 1").select("class_id"))
    # Only in classes of several documents does it matter which id is the smallest.
    several = pin(classes.join(shared, "class_id", "left_semi").select("__key", "class_id"))
    named = _one_per_key(keyed.select("__key", "__id"), repeated).join(several, "__key")
    stays = named.groupBy("class_id").agg(F.min(F.struct("__id", "__key"))["__key"].alias("__key")).select("__key")
    dropped = pin(several.select("__key").join(stays, "__key", "left_anti"))
    kept = keyed.join(small(dropped), "__key", "left_anti")
    return _one_per_key(kept, repeated).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a benchmark item, up to edits. They are told by a digest of their text."""
    with_scratch(spark)
    digested = docs.select("*", F.md5("text").alias("__digest"))
    leaks = find_leaks(digested.select("__digest", "text"), table(spark, sf_dir, "benchmark"), doc_id="__digest")
    leaking = pin(leaks.select(F.col("doc_id").alias("__digest")).distinct())
    return digested.join(small(leaking), "__digest", "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in brackets; ``n_chars`` follows."""
    plain, names = _renamed(docs)
    rest = tuple(n for c, n in names.items() if c not in ("doc_id", "text"))
    found = find_pii(plain, names["doc_id"], names["text"], masked=True, keep=rest)
    result = {c: F.col(n) for c, n in names.items()} | {"doc_id": F.col("doc_id"), "text": F.col("masked_text")}
    if "n_chars" in names:
        chars = F.length("masked_text").cast(docs.schema["n_chars"].dataType)
        result["n_chars"] = F.when(F.size("spans") > 0, chars).otherwise(F.col(names["n_chars"]))
    return found.select(*[result[c].alias(c) for c in names])


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as taken by the mix, once per copy, with each copy's place in its source.

    The place is in columns ``mix_*``; columns of those names that came in give way.
    """
    with_scratch(spark)
    # Rows of one key are equal in every column, so any of them stands for all that the mix took.
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    keyed = docs.select("*", F.xxhash64(*plain, *[c.isNull() for c in plain]).alias("__key"))
    mix = mix_sources(keyed.drop("doc_id").withColumnRenamed("__key", "doc_id"), entropy_share=0.999)
    places = ("epoch", "block", "start_token", "tokens", "source_tokens")
    mix = pin(mix.select(F.col("doc_id").alias("__key"), *[F.col(c).alias(f"mix_{c}") for c in places]))
    repeated = pin(keyed.groupBy("__key").count().where("count > 1").select("__key"))
    clashing = [c for c in docs.columns if c.lower() in {f"mix_{p}" for p in places}]
    return _one_per_key(keyed.drop(*clashing), repeated).join(mix, "__key").drop("__key")


STAGES = [
    ("language", keep_known_languages),
    ("near_copies", keep_one_of_near_copies),
    ("benchmark", drop_benchmark_leaks),
    ("personal_data", mask_personal_data),
    ("mix", mix_to_weights),
]

# Languages, edit distances and disguises are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, written between stages to the session's shared folder."""
    with_scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
