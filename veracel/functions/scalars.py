"""Hashes, vectors, normalisers and term weights as column expressions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize


def hash_int(key: Column) -> Column:
    """First eight hexadecimal digits of SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")


def hash_fraction(key: Column) -> Column:
    """First eight bytes of SHA-256 as a fraction of the largest such number."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / 18446744073709551615.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, epsilon: float | None = None) -> Column:
    """Cosine similarity: 0 for a zero norm, or with epsilon added to the product of norms."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    if epsilon is not None:
        return dot(a, b) / (norm + epsilon)
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def canonical_domain(domain: Column) -> Column:
    d = F.lower(F.trim(domain))
    d = F.when(d.isin("code_security", "code-security"), "code").when(d == "biology", "bio").otherwise(d)
    known = d.isin("hallucination", "code", "reasoning", "bio")
    return F.when(known, d).otherwise(F.raise_error(F.concat(F.lit("unsupported domain: "), domain)).cast("string"))


def ternary(values: Column, limit: float = 1.0) -> Column:
    """-1, 0 or 1 by strict limits, of each element."""
    return F.transform(values, lambda x: F.when(x > limit, 1).when(x < -limit, -1).otherwise(0))


def confidence(score: Column) -> Column:
    return F.least(2 * F.abs(score - 0.5), F.lit(1.0))


#: Words whose counts are broadcast at most, and characters of a partition of documents.
FREQUENT_WORDS, PART_CHARS = 200_000, 8_000_000


def _frequent(df: DataFrame, most: int) -> int:
    """The least count that so few words have, or more, that they can be broadcast. df: word, df."""
    words, least = 0, 1 << 62
    for r in df.groupBy("df").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("df")).toLocalIterator():  # a row a count
        words += r.n
        if words > most:
            break
        least = r.df
    return least


def tfidf(docs: DataFrame, words_of) -> DataFrame:
    """id, word, weight: (1 + ln tf) (1 + ln((1 + n) / (1 + df))), each document's weights of norm 1; documents of one id are one.

    docs: id, text; words_of: the words of a text column.  Pairs of document and word are never shuffled but for rare words:
    the counts of the most frequent ones are broadcast, those of the others are sent to their documents, which are dealt by id once."""
    facts = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), (F.count_distinct("id") == F.count(F.lit(1))).alias("single")).first()
    n, parts = facts.n, max(1, facts.chars // PART_CHARS)
    key = F.col("id") if facts.single else F.coalesce(F.col("id").cast("string"), F.lit("null"))
    docs = docs.select(key.alias("key"), "id", "text")
    each = docs.select("key", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word"))
    each = each if facts.single else each.distinct()
    df = materialize(each.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "words")
    least = _frequent(df, FREQUENT_WORDS)
    often = F.broadcast(df.where(F.col("df") >= least).withColumnRenamed("df", "often"))
    rare = each.join(often, "word", "left_anti").join(df.where(F.col("df") < least), "word").groupBy("key").agg(F.collect_list(F.struct("word", F.lit(0).alias("tf"), "df")).alias("rare"))  # of one document
    own = docs.repartition(parts, "key").join(rare.hint("shuffle_hash"), "key", "left")
    told = F.transform(words_of(F.col("text")), lambda w: F.struct(w.alias("word"), F.lit(1).alias("tf"), F.lit(None).cast("long").alias("df")))
    counts = own.select("key", "id", F.inline(F.concat(told, F.coalesce("rare", F.array().cast("array<struct<word:string,tf:int,df:bigint>>")))))
    counts = counts.groupBy("key", "word").agg(F.first("id").alias("id"), F.sum("tf").alias("tf"), F.max("df").alias("df"))
    raw = (1 + F.log("tf")) * (F.log((F.lit(n) + 1) / (F.coalesce("df", "often") + 1)) + 1)
    weighed = counts.join(often, "word", "left").select("key", "id", "word", raw.alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("key")))
    return weighed.select("id", "word", (F.col("raw") / norm).alias("weight"))


def top_words(weights: DataFrame, k: int) -> DataFrame:
    """id, rank, word, weight of each document's k heaviest words."""
    rounded = weights.withColumn("weight", F.round("weight", 6))
    order = Window.partitionBy("id").orderBy(F.desc("weight"), "word")
    return rounded.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("id", "rank", "word", "weight")


def classify_paths(paths: DataFrame, include: tuple[str, ...], exclude: tuple[str, ...]) -> DataFrame:
    """included: whether the longest include rule that starts the path is longer than any such exclude rule."""
    longest = lambda rules: F.greatest(F.lit(-1), F.lit(-1), *[F.when(F.startswith(F.col("path"), F.lit(r)), len(r)).otherwise(-1) for r in rules])
    return paths.withColumn("included", longest(include) > longest(exclude))
