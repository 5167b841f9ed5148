"""Text features as column expressions, and the few that need a Python function."""

import ast
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: word lists and patterns ----
HEDGING = ("may", "might", "possibly", "perhaps", "could", "likely", "suggest", "appears", "seems", "indicate", "potentially")
CERTAINTY = ("always", "never", "proven", "definitely", "certainly", "undoubtedly", "clearly", "obviously", "absolutely", "must")
EXAGGERATION = ("revolutionary", "breakthrough", "unprecedented", "miraculous", "amazing", "incredible", "extraordinary", "groundbreaking")
CONTROVERSY = ("controversial", "debate", "disputed", "disagree", "conflict")
CITATIONS = (r"\b10\.\d{4,}/\S+", r"PMID:\s*\d+", r"\[\d+\]", r"\(\w+\s+et\s+al\.,?\s+\d{4}\)", r"\(\w+,?\s+\d{4}\)")
DANGER = (r"(?i)\bcure[sd]?\b", r"\b100\s*%\b", r"(?i)\bguarantee[sd]?\b", r"(?i)\bproven\s+to\b", r"(?i)\bno\s+side\s+effects?\b")
QUANTITIES = r"(?i)\b\d+\.?\d*\s*%|\b\d+\.?\d*\s*(mg|kg|ml|mmol|patients?|subjects?|years?)\b"
SENTENCE_HEDGING = ("may", "might", "possibly", "suggests", "appears", "likely", "approximately")
QUESTION_WORDS = ("who", "what", "when", "where", "why", "how", "which", "is", "are", "do", "does", "can", "could")
PAREN_CITATION = r"\([A-Z][a-z]+(?:\s+(?:et\s+al\.?|and|&)\s+[A-Z][a-z]+)*,?\s*\d{4}\)"
NARRATIVE_CITATION = r"[A-Z][a-z]+(?:\s+et\s+al\.?|\s+(?:and|&)\s+[A-Z][a-z]+)?\s+\(\d{4}\)"
BRACKET_CITATION = r"\[\d+\]"
SENTENCE_END = r"[.!?]+\s+|[.!?]+$"
CONNECTIVES = ("therefore", "thus", "hence", "because", "since", "if", "then", "implies", "consequently", "however", "but", "although", "nevertheless")
NEGATION = r"(?i)\b(?:not|no|never|neither|nor|cannot|can't|don't|doesn't|isn't|won't|shouldn't|wouldn't|hasn't)\b"
PREMISES = ("given", "assuming", "suppose", "let", "consider")
CONCLUSIONS = ("therefore", "thus", "hence", "so", "conclude", "follows")
ORDINALS = ("first", "second", "third", "fourth", "fifth", "next", "then", "finally", "therefore", "thus", "hence")
NUMBER = r"-?\d+\.?\d*(?:[eE][+-]?\d+)?"
UNITS = r"\b(?:mM|uM|nM|pM|ng/mL|ug/mL|mg/mL|kDa|bp|kb|Mb|rpm|CFU|OD|pH|Celsius|Kelvin|mol/L|g/L)\b"
STATISTICS = (
    r"\bmean\b", r"\bmedian\b", r"\bstd\b", r"\bstandard deviation\b", r"\bvariance\b", r"\bCI\b", r"\bconfidence interval\b", r"\bp-value\b",
    r"\bp =", r"\br =", r"\bR\^2\b", r"\bR-squared\b", r"\bANOVA\b", r"\bt-test\b", r"\bchi-square\b",
)
RANGES = (
    (r"(?i)\bpH\b", 0.0, 14.0), (r"(?i)\b(?:temperature|temp)\b", -20.0, 200.0), (r"(?i)\b(?:concentration|conc)\b", 0.0, math.inf),
    (r"(?i)\b(?:expression|fold change)\b", 0.0, math.inf), (r"(?i)\bp[- ]?value\b", 0.0, 1.0), (r"(?i)\b(?:percentage|percent)\b|%", 0.0, 100.0),
)
DANGEROUS_CALLS = {"system", "popen", "call", "run", "Popen", "eval", "exec", "__import__", "compile"}
RISKY_MODULES = {"pickle", "shelve", "marshal", "ctypes", "subprocess", "os"}
CREDENTIALS = ("password", "secret", "key", "token", "api_key")
DENDRITIC = ("claim_density", "citation_count", "hedging_ratio", "specificity", "numeric_density", "pamp_score", "exaggeration", "certainty", "controversy", "danger_signal")


def strings(values) -> Column:
    return F.array(*map(F.lit, values))


def tokens(text: Column) -> Column:
    """Parts between white space, none for a blank text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def pair_text(prompt: Column, output: Column) -> Column:
    return F.concat(F.coalesce(prompt, F.lit("")), F.lit(" "), F.coalesce(output, F.lit("")))


def code_from(code: Column, output: Column) -> Column:
    """Code of a sample: its own, else its output, else nothing."""
    return F.coalesce(F.nullif(code, F.lit("")), F.nullif(output, F.lit("")), F.lit(""))


def unit(flag: Column) -> Column:
    return flag.cast("double")


def dendritic(text: Column) -> dict[str, Column]:
    """Ten features in [0, 1] by name."""
    low = tokens(F.lower(text))
    share = lambda words, most: F.least(F.size(F.array_intersect(low, strings(words))) / most, F.lit(1.0))
    has = lambda words: unit(F.arrays_overlap(low, strings(words)))
    cited = unit(F.greatest(*[text.rlike(p) for p in CITATIONS]))
    alarms = sum((text.rlike(p).cast("int") for p in DANGER), F.lit(0))
    pamp, over = F.least(alarms / 3, F.lit(1.0)), share(EXAGGERATION, 3)
    capital = F.size(F.filter(tokens(text), lambda w: w.rlike(r"(?s)^\p{Lu}.")))
    density = 0.5 + 0.2 * cited + 0.1 * has(HEDGING) - 0.2 * unit(over > 0.5) - 0.3 * unit(pamp > 0.5)
    return {
        "claim_density": clip(density), "citation_count": cited, "hedging_ratio": has(HEDGING),
        "specificity": F.least(capital / F.greatest(F.size(low), F.lit(1)) * 5, F.lit(1.0)),
        "numeric_density": unit(F.lower(text).rlike(QUANTITIES)), "pamp_score": pamp, "exaggeration": over, "certainty": has(CERTAINTY),
        "controversy": share(CONTROVERSY, 2), "danger_signal": F.least(alarms / 5, F.lit(1.0)),
    }


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def hallucination(prompt: Column, output: Column) -> dict[str, Column]:
    text = F.trim(pair_text(prompt, output))
    blank, parts = text == "", sentences(text)
    n = F.greatest(F.size(parts), F.lit(1))
    formal = matches(text, PAREN_CITATION) + matches(text, NARRATIVE_CITATION)
    cites = formal + matches(text, BRACKET_CITATION)
    words = F.size(tokens(text))
    stated = F.size(F.filter(parts, lambda s: ~F.element_at(tokens(F.lower(s)), 1).isin(*QUESTION_WORDS) & ~F.endswith(s, F.lit("?"))))
    hedged = F.size(F.filter(parts, lambda s: F.arrays_overlap(tokens(F.lower(s)), strings(SENTENCE_HEDGING))))
    made = {
        "claim_density": stated / n, "citation_count": cites, "citation_pattern_score": F.when(cites > 0, formal / cites).otherwise(0.0),
        "hedging_ratio": hedged / n, "numeric_claim_density": F.when(words > 0, matches(text, r"\b\d+\.?\d*\b") / words).otherwise(0.0),
        "avg_sentence_length": words / n, "text_length": (F.length(prompt) + F.length(output)).cast("double"),
    }
    return {k: F.when(blank, 0.0).otherwise(v) for k, v in made.items()}


def reasoning(prompt: Column, output: Column) -> dict[str, Column]:
    """The features that expressions can give; steps and contradictions come from reasoning_steps()."""
    text = F.trim(pair_text(prompt, output))
    words = tokens(F.lower(text))
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[.,;:!?()\"']+|[.,;:!?()\"']+$", ""))
    among = lambda ws: F.size(F.filter(bare, lambda w: w.isin(*ws)))
    links = among(CONNECTIVES) + matches(text, r"(?i)\bfollows\s+that\b")
    premise, end = among(PREMISES), among(CONCLUSIONS)
    return {
        "connective_density": F.when(F.size(words) > 0, links / F.size(words)).otherwise(0.0),
        "negation_count": matches(text, NEGATION),
        "premise_conclusion_ratio": F.when((premise > 0) & (end > 0), F.least(premise / F.greatest(end, F.lit(1)), F.lit(5.0))).when(premise > 0, 5.0).otherwise(1.0),
        "total_length": (F.length(prompt) + F.length(output)).cast("double"),
    }


def bio(prompt: Column, output: Column) -> dict[str, Column]:
    text = F.trim(pair_text(prompt, output))
    values = F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), 1), lambda v: v.cast("double"))
    n = F.size(values)
    mean = F.when(n > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n)
    # what a fold needs stands in its state, else it would be worked out for every element
    spread = F.aggregate(values, F.struct(mean.alias("m"), F.lit(0.0).alias("s")), lambda a, v: F.struct(a["m"].alias("m"), (a["s"] + (v - a["m"]) * (v - a["m"])).alias("s")), lambda a: a["s"])
    var = F.when(n > 0, spread / n)
    count = F.struct(mean.alias("m"), F.sqrt(var).alias("d"), F.lit(0).alias("k"))
    far = F.aggregate(values, count, lambda a, v: F.struct(a["m"].alias("m"), a["d"].alias("d"), (a["k"] + (F.abs((v - a["m"]) / a["d"]) > 3).cast("int")).alias("k")), lambda a: a["k"])
    some = F.filter(F.transform(values, F.abs), lambda v: v > 0)
    return {
        "numeric_value_count": n.cast("double"), "z_score_outlier_count": F.when((n >= 3) & (var >= 1e-10), far).otherwise(0).cast("double"),
        "negative_value_count": F.size(F.filter(values, lambda v: v < 0)).cast("double"), "unit_mention_count": matches(text, UNITS),
        "value_magnitude_range": F.when(F.size(some) >= 2, F.log10(F.array_max(some) / F.array_min(some))).otherwise(0.0),
        "statistical_summary_count": sum((matches(text, "(?i)" + p) for p in STATISTICS), F.lit(0.0)),
        "out_of_range_count": F.when(text.rlike("[0-9]"), out_of_range(text)).otherwise(0.0),
    }


def out_of_range(text: Column) -> Column:
    """Numbers outside the range of a keyword in the 50 characters before them.

    The text is cut at its numbers, so each number's context is the tail of what came before it."""
    gaps = F.split(text, NUMBER)
    values = F.regexp_extract_all(text, F.lit(f"({NUMBER})"), 1)
    start = F.struct(F.lit("").alias("before"), F.lit(0).alias("n"))

    def step(state, pair):
        head = F.concat(state["before"], pair["gap"])
        tail, v = F.right(head, F.lit(50)), pair["value"].cast("double")
        bad = F.lit(False)
        for pattern, low, high in RANGES:
            bad = bad | (tail.rlike(pattern) & ((v < low) | (v > high)))
        return F.struct(F.right(F.concat(head, pair["value"]), F.lit(50)).alias("before"), (state["n"] + bad.cast("int")).alias("n"))

    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(values)).alias("gap"), values.alias("value"))
    return F.aggregate(pairs, start, step)["n"].cast("double")


# ---- Python functions, where no expression exists ----
def count_steps(text: str) -> int:
    """Distinct places of step markers, ordinal words and list numbers."""
    import re

    low = text.lower()
    found = {m.start() for m in re.finditer(r"(?i)step\s+\d+", text)} | {m.start() for m in re.finditer(r"(?m)^\d+[.)]\s", text)}
    at = 0
    for i, w in enumerate(low.split()):
        bare = w.strip(".,;:!?")
        if bare in ORDINALS:
            place = low.find(bare, at - 1 if i else 0)
            if place >= 0:
                found.add(place)
        at += len(w) + 1
    return len(found)


def contradictions(text: str) -> tuple[int, int]:
    """(pairs of claims that differ in negation alone, sentences)."""
    import re
    from collections import Counter

    parts = [s for s in (p.strip() for p in re.split(SENTENCE_END, text)) if s]
    claims = Counter()
    for s in parts:
        for m in re.finditer(r"(?i)\b(\w+(?:\s+\w+)?)\s+(?:is|are)\s+(not\s+)?(\w+(?:\s+\w+)?)", s):
            claims[m[1].lower(), m[3].lower(), bool(m[2])] += 1
    return sum(n * claims[a, b, True] for (a, b, negated), n in claims.items() if not negated), len(parts)


def _reasoning_steps(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for t in texts:
            t = (t or "").strip()
            steps, (pairs, parts), words = count_steps(t), contradictions(t), len(t.split())
            rows.append((float(steps), min(pairs / parts, 1.0) if parts else 0.0, words / (steps or parts or 1)))
        yield pd.DataFrame(rows, columns=["step_count", "contradiction_score", "avg_step_length"])


def reasoning_steps(text: Column) -> Column:
    return F.pandas_udf(_reasoning_steps, "struct<step_count:double,contradiction_score:double,avg_step_length:double>")(text)


CODE_FEATURES = ("dangerous_call_count", "string_concat_in_call", "hardcoded_credential_score", "import_risk_score", "ast_node_depth", "exec_eval_usage", "total_function_calls")


def code_features(code: str | None) -> tuple[float, ...]:
    """Seven counts from the syntax tree; zeros for blank or broken code."""
    zero = (0.0,) * 7
    if not code or not code.strip():
        return zero
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return zero
    danger = concat = credential = risk = depth = execs = calls = 0
    level = [(tree, 0)]
    while level:
        node, at = level.pop()
        depth = max(depth, at)
        level += [(child, at + 1) for child in ast.iter_child_nodes(node)]
        match node:
            case ast.Call(func=f, args=args, keywords=kws):
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""
                calls += 1
                danger += name in DANGEROUS_CALLS
                execs += name in ("eval", "exec")
                concat += any(isinstance(a, ast.BinOp) and isinstance(a.op, ast.Add) for a in [*args, *(k.value for k in kws)])
            case ast.Assign(targets=targets, value=ast.Constant(value=str())):
                names = [getattr(t, "id", getattr(t, "attr", "")).lower() for t in targets if isinstance(t, (ast.Name, ast.Attribute))]
                credential += sum(any(c in n for c in CREDENTIALS) for n in names)
            case ast.Import(names=names):
                risk += sum(a.name.split(".")[0] in RISKY_MODULES for a in names)
            case ast.ImportFrom(module=str() as module):
                risk += module.split(".")[0] in RISKY_MODULES
    return tuple(map(float, (danger, concat, credential, risk, depth, execs, calls)))


def _code_security(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for codes in batches:
        yield pd.DataFrame([code_features(c) for c in codes], columns=CODE_FEATURES)


def code_security(code: Column) -> Column:
    return F.pandas_udf(_code_security, "struct<" + ",".join(f"{c}:double" for c in CODE_FEATURES) + ">")(code)


def higuchi(signal: np.ndarray, longest: int = 10) -> float:
    """Fractal dimension: slope of log curve length against log inverse interval; 1.5 for short signals."""
    n = len(signal)
    if n < longest:
        return 1.5
    points = []
    for k in range(1, longest + 1):
        lengths = []
        for first in range(k):
            steps = (n - first - 1) // k
            if steps:
                path = signal[first : first + steps * k + 1 : k]
                lengths.append(np.abs(np.diff(path)).sum() * (n - 1) / (steps * k * k))
        if lengths and (mean := float(np.mean(lengths))) > 0:
            points.append((-math.log(k), math.log(mean)))
    if len(points) < 2:
        return 1.5
    x, y = np.array(points).T
    return float(np.clip(np.polyfit(x, y, 1)[0], 1.0, 2.0))


FRACTAL = ("hfd_char_dist", "hfd_word_lengths", "hurst_word_lengths", "hurst_sentence_lengths", "shannon_char", "shannon_word", "shannon_bigram", "complexity_index")
HURST = 0.5  # what the exponent is without its library


def entropy(counts: np.ndarray) -> float:
    """Shannon entropy in bits of values with these counts."""
    n = counts.sum()
    return float(np.log2(n) - (counts * np.log2(counts)).sum() / n) if n else 0.0


def fractal_vector(text: str | None) -> tuple[float, ...]:
    """The eight columns of FRACTAL from one pass over a text; fixed values for a blank one."""
    words = (text or "").split()
    if not words:
        return (1.5, 1.5, HURST, HURST, 0.0, 0.0, 0.0, 0.0)
    chars = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)[1].astype(float)
    of: dict[str, int] = {}
    ids = np.fromiter((of.setdefault(w, len(of)) for w in words), np.int64, len(words))
    word_counts = np.bincount(ids).astype(float)
    pairs = np.unique(ids[:-1] * len(of) + ids[1:], return_counts=True)[1].astype(float)
    by_words = higuchi(np.fromiter(map(len, words), float, len(words)))
    return (higuchi(chars), by_words, HURST, HURST, entropy(chars), entropy(word_counts), entropy(pairs), (by_words - 1) * (1.5 - HURST))


def _fractal(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([fractal_vector(t) for t in texts], columns=FRACTAL)


def fractal(text: Column) -> Column:
    return F.pandas_udf(_fractal, "struct<" + ",".join(f"{c}:double" for c in FRACTAL) + ">")(text)


def with_features(df: DataFrame, features: dict[str, Column], *keep: str) -> DataFrame:
    return df.select(*keep, *[v.alias(k) for k, v in features.items()])
