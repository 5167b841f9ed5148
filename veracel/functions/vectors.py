"""Sparse text vectors: a fitted vocabulary as a table, and TF-IDF over words and pairs of words."""

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Terms of a vocabulary at most, so that it can be broadcast.
MAX_TERMS = 5000

#: Words, of two characters or more.
WORD = r"[\p{L}\p{N}_]{2,}"

# A parameter: common English words that are no terms.
STOP_WORDS = tuple(
    """about above after again against all also am an and any are as at be because been before being below between both but by can could did do does doing down
    during each few for from further had has have having he her here hers him his how if in into is it its just me more most my no nor not now of off on once
    only or other our ours out over own same she should so some such than that the their theirs them then there these they this those through to too under
    until up us very was we were what when where which while who whom why will with would you your yours""".split()
)


def with_grams(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with grams: the lower-case words of a text that are no stop words, and the pairs of them that follow each other."""
    words = F.filter(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS))
    pairs = F.zip_with("__w", F.slice("__w", F.lit(2), F.greatest(F.size("__w"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return docs.withColumn("__w", words).withColumn("grams", F.concat("__w", F.filter(pairs, lambda p: p.isNotNull()))).drop("__w")


def vocabulary(docs: DataFrame, most: int = MAX_TERMS) -> DataFrame:
    """index, term, tf, df, idf of the `most` terms that occur most often in docs (ties by term), numbered by term.  docs: id, text.

    Terms are counted before they are shuffled, and documents only for the terms that stay."""
    g = with_grams(docs).select("grams")
    n = g.count()
    often = g.select(F.explode("grams").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("tf")).orderBy(F.desc("tf"), "term").limit(most)
    in_docs = g.select(F.explode(F.array_distinct("grams")).alias("term")).join(F.broadcast(often.select("term")), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    met = often.join(in_docs, "term").withColumn("idf", F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1)
    return met.select((F.row_number().over(Window.orderBy("term")) - 1).alias("index"), "term", "tf", "df", "idf")  # `most` rows


def weights(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """id, index, weight: (1 + ln tf) idf of the vocabulary's terms in each text, each text's weights of norm 1."""
    met = with_grams(docs).select("id", F.explode("grams").alias("term")).join(F.broadcast(terms.select("term", "index", "idf")), "term")
    tf = met.groupBy("id", "index").agg(F.count(F.lit(1)).alias("tf"), F.first("idf").alias("idf"))
    raw = tf.select("id", "index", ((1 + F.log("tf")) * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id")))
    return raw.select("id", "index", (F.col("raw") / norm).alias("weight"))


def vectors(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """id, v (struct of indices, by number, and weights) of every text; one without terms has empty arrays."""
    kind = "array<struct<index:int,weight:double>>"
    packed = weights(docs, terms).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("index", "weight"))).alias("e"))  # as many as there are terms
    each = docs.select("id").join(packed, "id", "left").withColumn("e", F.coalesce("e", F.array().cast(kind)))
    return each.select("id", F.struct(F.col("e.index").alias("indices"), F.col("e.weight").alias("weights")).alias("v"))


def dense(rows, width: int) -> np.ndarray:
    """Sparse vectors (dicts, rows or pairs of indices and weights) as a matrix."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, np.asarray(r["indices"], int)] = r["weights"]
    return out


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two sparse vectors of norm 1: the products over the terms of both."""
    mine = F.map_from_arrays(b["indices"], b["weights"])
    return F.aggregate(F.arrays_zip(a["indices"].alias("i"), a["weights"].alias("w")), F.lit(0.0), lambda s, e: s + e["w"] * F.coalesce(F.try_element_at(mine, e["i"]), F.lit(0.0)))
