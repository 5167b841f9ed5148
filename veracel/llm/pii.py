"""Personal data: base patterns, then bootstrapped contextual extraction.

Base spans (e-mail, IP, card, phone) are the seeds.  Every mention, seed or
candidate of a looser shape, has lexical patterns: the word and the two words before it, and those
after it.  Spark scores the graph of patterns and instances in rounds: a pattern's
confidence for a kind is the lower Wilson bound of the share of the known ones among
its instances that are known to be of that kind or contrary to it, where candidates
of that kind not yet known are unlabelled, so some noise lowers a pattern and does
not kill it; an instance's is the noisy-or of its best pattern on each side.  Instances that reach the threshold count as known in the next round,
so they induce further patterns.  Candidate mentions of instances known at the
end become spans beside the base ones.

Very long texts are read whole, in time in proportion to their length.  Null and empty texts have no spans.  Repeated rows each get their own row, and
one instance counts once for a pattern however often it is repeated.  Only doc_id
and text are read, so other columns cannot clash.
"""

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

KINDS = ("email", "ip", "card", "phone")
ORDER = {k: i for i, k in enumerate(KINDS)}

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Looser shapes of identifiers that only a good pattern makes believable.
LOOSE = (
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("phone", re.compile(r"(?<![\w+])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}(?:[\x20.-][0-9]{2,4}){1,3}(?!\w)")),
    ("card", re.compile(r"(?<![\w-])[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{1,7}(?![\w-])")),
)
LOOSE_AT = re.compile(r"@|\x20?[\[(]at[\])]\x20?")
LOOSE_LOCAL = re.compile(r"[\w.+-]*+")  # from its end backwards
LOOSE_DOMAIN = re.compile(r"[\w-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[\w-]++)+")
OTHER = re.compile(r"(?<!\S)\S*[0-9]\S*")

WORD_CHARS, NEAR = 256, 1280
MIN_SEEDS = 5  # distinct known instances before a pattern counts
MIN_PATTERN = 0.5  # confidence of patterns that count
MIN_CONFIDENCE = 0.8  # of instances to become known
ROUNDS = 3

MENTION = "struct<kind:string,s:int,e:int,inst:string,seed:boolean,left:string,right:string>"
SCANNED = f"struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base:string,mentions:array<{MENTION}>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping matches, found from each @ so that long runs cost no more than their length."""
    end, at = 0, text.find("@")
    while at >= 0:
        head = text[end:at]
        start = end + len(head.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        end = m.end() if m else at + 1
        if m:
            yield start, end
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by kind as listed, then start."""
    found = [(a, b, "email") for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
                found.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (ORDER[s[2]], s[0], s[1]))


def loose_emails(text: str):
    """Leftmost non-overlapping matches of local part, @ or [at], and parts of a domain between dots or [dot], found from each
    @ or [at] outwards so that long runs cost no more than their length."""
    end = last = 0  # a local part begins after the match or the @ before it
    at = LOOSE_AT.search(text)
    while at:
        start = at.start() - LOOSE_LOCAL.match(text[last : at.start()][::-1]).end()
        m = LOOSE_DOMAIN.match(text, at.end()) if start < at.start() else None
        end = m.end() if m else end
        if m:
            yield start, end
        last = max(end, at.end())
        at = LOOSE_AT.search(text, last)


def _context(text: str, lo: int, hi: int) -> tuple[str, str]:
    """The two words before and the two after.  Of words longer than WORD_CHARS the nearest characters stand for the word, and
    words further off than NEAR characters are not looked for, so that a text without blanks costs no more than its length."""
    clean = lambda ws, cut: " ".join("0" if DIGIT.search(w) else w[cut] for w in ws)
    near = 80
    while True:
        part = text[max(0, lo - near) : lo]
        before = part.lower().split()
        if near >= min(lo, NEAR) or len(before) > 2 or (len(before) == 2 and part[0].isspace()):
            break
        near *= 4
    near = 80
    while True:
        part = text[hi : hi + near]
        after = part.lower().split()
        if near >= min(len(text) - hi, NEAR) or len(after) > 2 or (len(after) == 2 and part[-1].isspace()):
            break
        near *= 4
    return clean(before[-2:], slice(-WORD_CHARS, None)), clean(after[:2], slice(WORD_CHARS))


def mentions(text: str, base) -> list[dict]:
    """Seeds, loosely shaped candidates, and other tokens with digits (kind null), with their contexts."""
    taken = sorted((a, b) for a, b, _ in base)
    found = [(a, b, k, True) for a, b, k in base]

    def free(a, b):
        i = bisect.bisect_left(taken, (a, a))
        return not ((i < len(taken) and taken[i][0] < b) or (i and taken[i - 1][1] > a))

    if not (DIGIT.search(text) or "@" in text or "at]" in text or "at)" in text):
        return []
    shapes = [("email", loose_emails), *((kind, shape.finditer) for kind, shape in LOOSE)]
    for kind, find in shapes:
        new = [m if kind == "email" else m.span() for m in find(text)]
        for a, b in new:
            if free(a, b):
                found.append((a, b, kind, False))
        taken = sorted(taken + [(a, b) for a, b in new if free(a, b)])
    if DIGIT.search(text):
        found += [(m.start(), m.end(), None, False) for m in OTHER.finditer(text) if free(m.start(), m.end())]
    out = []
    for a, b, kind, seed in found:
        left, right = _context(text, a, b)
        out.append({"kind": kind, "s": a, "e": b, "inst": text[a:b].lower(), "seed": seed, "left": left, "right": right})
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    @F.pandas_udf(SCANNED)
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                text = text or ""
                base = base_spans(text)
                n = {k: 0 for k in KINDS}
                for *_, k in base:
                    n[k] += 1
                rows.append((*n.values(), joined(base), mentions(text, base)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "mentions"])

    return small_batches(docs).select("doc_id", look("text").alias("r")).select("doc_id", "r.*")


def wilson(n, of):
    """Lower bound of a share at one standard error; 1 of 1 is 0.5, 5 of 5 are 0.83, 11 of 12 are 0.8."""
    p, spread = n / of, F.sqrt(n * (of - n) / (of * of * of) + 1 / (4 * of * of))
    return (p + 1 / (2 * of) - spread) / (1 + 1 / of)


def known_instances(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(inst, kind) believed after scoring the pattern-instance graph; found: inst, kind, seed, left, right."""
    near = F.array(
        F.concat(F.lit("l2 "), "left"), F.concat(F.lit("l1 "), F.substring_index("left", " ", -1)),
        F.concat(F.lit("r2 "), "right"), F.concat(F.lit("r1 "), F.substring_index("right", " ", 1)),
    )
    edges = materialize(
        found.select("inst", "kind", "seed", F.explode(near).alias("pattern"))
        .where("length(pattern) > 3")
        .groupBy("pattern", "inst").agg(F.max("kind").alias("kind"), F.max("seed").alias("seed")),
        "edges",
    )
    known = edges.where("seed").select("inst", "kind").distinct()
    open_edges = edges.where("not seed and kind is not null")
    for _ in range(rounds):
        sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("size"))
        marked = edges.select("pattern", "inst").join(known, "inst")
        loose = edges.where("kind is not null").select("pattern", "inst", "kind").join(known, "inst", "left_anti")
        same = marked.unionByName(loose, allowMissingColumns=True).groupBy("pattern", "kind").agg(F.countDistinct("inst").alias("same"))
        good = (
            marked.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= MIN_SEEDS)
            .join(sizes, "pattern").join(same, ["pattern", "kind"])
            .withColumn("conf", wilson(F.col("n"), F.col("n") + F.col("size") - F.col("same")))
            .where(F.col("conf") >= MIN_PATTERN)
        )
        fresh = (
            open_edges.join(good.select("pattern", "kind", "conf"), ["pattern", "kind"])
            .groupBy("inst", "kind", F.substring("pattern", 1, 1).alias("side")).agg(F.max("conf").alias("conf"))
            .groupBy("inst", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("conf"))))).alias("p"))
            .where(F.col("p") >= MIN_CONFIDENCE).select("inst", "kind")
        )
        known = materialize(known.unionByName(fresh).distinct(), "known")
    return known


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: base counts and digest, all spans, n_found of them by context."""
    scanned = materialize(scan_documents(docs), "scanned").withColumn("row", F.monotonically_increasing_id())
    scanned = materialize(scanned, "scanned-rows")
    each = scanned.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    known = known_instances(each, rounds)
    new = (
        each.where("not seed and kind is not null").join(known, ["inst", "kind"])
        .groupBy("row").agg(F.collect_set(F.struct("kind", "s", "e")).alias("new"))
    )
    base = F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ","))
    as_struct = lambda x: F.struct(
        F.array_position(F.array(*map(F.lit, KINDS)), F.split_part(x, F.lit(":"), F.lit(1))).alias("k"),
        F.split_part(x, F.lit(":"), F.lit(2)).cast("int").alias("s"), F.split_part(x, F.lit(":"), F.lit(3)).cast("int").alias("e"),
    )
    added = F.transform("new", lambda x: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    name = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"].cast("int")), x["s"], x["e"])
    every = F.array_sort(F.concat(F.transform(base, as_struct), F.coalesce(added, F.array().cast("array<struct<k:bigint,s:int,e:int>>"))))
    return scanned.join(new, "row", "left").select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"),
        F.when(F.col("new").isNull(), F.col("base")).otherwise(F.array_join(F.transform(every, name), ",")).alias("spans"),
        F.coalesce(F.size("new"), F.lit(0)).cast("long").alias("n_found"),
    )
