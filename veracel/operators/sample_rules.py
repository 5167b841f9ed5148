"""Rules over a set of samples and the manifest with their truth, as a table of issues."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a sample's difficulty, its source and the truth may be.
DIFFICULTIES = ("easy", "medium", "hard")
SOURCES = ("synthetic", "template", "llm")
TRUTHS = ("normal", "anomalous")


def sample_issues(samples: DataFrame, manifest: DataFrame) -> DataFrame:
    """id, issue: each rule that a sample or its entry breaks, an issue a row.

    samples: id, prompt, output, domain, code, metadata (struct of difficulty and source); null is missing.
    manifest: id, truth, type, is_honeypot (a boolean, or text that should read true or false), an entry an id.
    A sample without id is told by what it lacks alone, an entry without sample is an orphan; repeated
    samples are told each.  Samples and entries meet once, by id."""
    s = samples.select("id", "prompt", "output", "domain", "code", "metadata", F.lit(True).alias("sampled"))
    m = manifest.select(F.col("id").alias("__mid"), "truth", "type", F.col("is_honeypot").cast("string").alias("is_honeypot"), F.lit(True).alias("entered"))
    both = s.join(m, s.id == m["__mid"], "full")
    sampled, known, entered = F.col("sampled").isNotNull(), F.col("id").isNotNull(), F.col("entered").isNotNull()
    level, source = F.col("metadata.difficulty"), F.col("metadata.source")
    rules = {f"missing {c}": sampled & F.col(c).isNull() for c in ("id", "prompt", "output", "domain", "metadata")} | {
        "missing code": sampled & (F.col("domain") == "code_security") & F.col("code").isNull(),
        "not in manifest": sampled & known & ~entered,
        "missing truth": known & entered & F.col("truth").isNull(), "missing type": known & entered & F.col("type").isNull(), "missing is_honeypot": known & entered & F.col("is_honeypot").isNull(),
        "invalid truth": known & entered & ~F.col("truth").isin(*TRUTHS), "is_honeypot is no boolean": known & entered & ~F.col("is_honeypot").isin("true", "false"),
        "missing difficulty": known & level.isNull(), "invalid difficulty": known & ~level.isin(*DIFFICULTIES),
        "missing source": known & source.isNull(), "invalid source": known & ~source.isin(*SOURCES),
        "orphan": ~sampled,
    }
    told = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return both.select(F.coalesce("id", "__mid").alias("id"), F.explode(told).alias("issue"))
