"""A dictionary of phrases over whole texts, by an inverted index on each phrase's rarest word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.joins import join_counted
from gleaner.sources.shared import discard, materialize

#: Texts that hold one word and are handled in one task.
HOT = 10_000


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def find_phrases(docs: DataFrame, phrases: DataFrame, key: str, text: str, phrase_key: str, phrase: str) -> DataFrame:
    """(key, phrase_key, times) of all phrases that a text holds as a run of whole words; overlaps count.

    A phrase is looked up by the word of it that the fewest texts hold (leftmost of equals). Texts meet phrases by that
    word only; then the neighbouring words are compared at each of its places. A phrase with a word that no text holds
    can't occur. Very frequent words are not gathered in a task: their phrases are sent to the texts. Phrases without
    words and null texts find nothing. Rows that agree in key and text count once, as do phrases that agree in
    phrase_key and words.
    """
    own = docs.select(F.col(key), F.xxhash64(text).alias("_t"), words_of(F.col(text)).alias("_w")).where("size(_w) > 0").dropDuplicates([key, "_t"])
    own = materialize(own, "phrase-texts", compression="zstd")
    wanted = phrases.select(F.col(phrase_key), words_of(F.col(phrase)).alias("_p")).where("size(_p) > 0").distinct()
    each = wanted.select(phrase_key, "_p", F.posexplode("_p").alias("_o", "_word"))
    held = own.select(key, "_t", F.explode(F.array_distinct("_w")).alias("_word")).join(each.select("_word").distinct(), "_word", "left_semi")
    df = materialize(held.groupBy("_word").agg(F.count("*").alias("m")), "phrase-words")
    rare = each.join(df, "_word", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    rare = rare.groupBy(phrase_key, "_p").agg(F.min(F.struct("m", "_o", "_word")).alias("r")).where("r.m > 0")
    index = rare.groupBy(F.col("r._word").alias("_word"), F.col("r.m").alias("m")).agg(F.collect_list(F.struct(F.col("r._o").alias("_o"), F.col("_p"), F.col(phrase_key).alias("_k"))).alias("_phrases"))
    index = materialize(index, "phrase-index")
    pairs = join_counted(held, index, "_word", HOT).select(key, "_t", "_word", F.explode("_phrases").alias("q"))
    met = pairs.select(F.col(key).alias("_key"), F.col("_t").alias("_text"), "_word", "q").join(own, F.col("_key").eqNullSafe(F.col(key)) & (F.col("_text") == F.col("_t")))
    at = F.expr("filter(sequence(1, greatest(1, size(_w) - size(q._p) + 1)), i -> i + q._o <= size(_w) and element_at(_w, i + q._o) = _word and slice(_w, i, size(q._p)) = q._p)")
    out = met.select(F.col(key), F.col("q._k").alias(phrase_key), F.size(at).cast("long").alias("times")).where("times > 0")
    out = materialize(out, "phrase-hits")
    discard(own, df, index)
    return out
