"""Rules over settings documents: kinds, ranges, unknown keys and keys that contradict each other, as a table of issues.

A document is JSON text (a settings file read by `documents`, or a column), with sections
as nested objects.  All rules are expressions over the text: a document is one row, and
nothing is shuffled.
"""

import json
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import values

# The known settings of each section, their kind, and their range or names; a key without a kind takes any value.
KNOWN = """
miner.detectors
miner.orchestrator.enabled
miner.orchestrator.nk.z_threshold number [0,]
miner.orchestrator.dca.pamp_threshold number [0,]
miner.orchestrator.dca.signal_weights
miner.orchestrator.dca.adaptive
miner.orchestrator.dca.adapt_alpha number (0,1]
miner.orchestrator.danger.alpha number [0,1]
miner.orchestrator.danger.enabled
miner.orchestrator.bcell.max_memory int (0,]
miner.orchestrator.bcell.k int (0,]
miner.orchestrator.bcell.bcell_weight number [0,1]
miner.orchestrator.bcell.half_life number (0,1]
miner.orchestrator.bcell.eviction_threshold
miner.orchestrator.bcell.jitter_sigma
miner.orchestrator.bcell.memory_dir
miner.orchestrator.bcell.embedding_mode
miner.orchestrator.bcell.embedding_sigma
miner.orchestrator.slm_nk.enabled
miner.orchestrator.slm_nk.similarity_threshold number [0,1]
miner.orchestrator.feedback.enabled
miner.orchestrator.feedback.lookback_rounds int (0,]
miner.orchestrator.telemetry.window_size
miner.model.model_name
miner.model.cache_dir
miner.model.device text auto|cpu|cuda
validator.rotation.enabled
validator.rotation.window int (0,]
validator.scoring.mode text exact|statistical|semantic
validator.scoring.repeats int (0,]
validator.scoring.ci_level number (0,1)
validator.policy.mode text global_threshold|domain_thresholds|operator_multiband
validator.policy.high_threshold number [0,1]
validator.policy.low_threshold number [0,1]
validator.policy.min_confidence number [0,1]
validator.audit.enabled bool
validator.audit.chain_path text
validator.convergence.window_size int (0,]
validator.convergence.sign_change_threshold int [0,]
validator.convergence.variance_bound number (0,]
validator.convergence.top_quantile_cut number (0,1]
validator.convergence.min_consecutive_rounds int (0,]
validator.convergence.epsilon number (0,1)
"""
# The same for the settings that a domain overrides, and the sections whose keys are free.
OF_DOMAIN = """
nk_z_threshold number [0,]
dca_pamp_threshold number [0,]
danger_alpha number [0,1]
danger_enabled
slm_nk_similarity_threshold number [0,1]
"""
FREE = ("neuron", "api", "miner.detectors", "miner.orchestrator.domains")
DOMAINS = "miner.orchestrator.domains"


def _lines(known: str) -> list[tuple[str, str, str]]:
    """key, kind, bounds of each line."""
    return [tuple((line.split() + ["", ""])[:3]) for line in known.split("\n") if line]


def sections() -> dict[str, list[str]]:
    """The keys known in each section that is checked; `root` is the document."""
    out = {"root": []}
    for key in [k for k, _, _ in _lines(KNOWN)] + list(FREE):
        parts = key.split(".")
        for i, name in enumerate(parts):
            within = out.setdefault(".".join(parts[:i]) or "root", [])
            if name not in within:
                within.append(name)
    return out


def _message(kind: str, bounds: str) -> str:
    if "|" in bounds:
        return f"must be one of {bounds}"
    return f"must be {kind} in {bounds}" if bounds else f"must be {kind}"


def _fits(kind: str, bounds: str, value: Column, found: Column) -> Column:
    """Whether a value (text) of the kind found (as a variant names it) keeps a rule."""
    number = found.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    whole = (found == "BIGINT") | found.rlike(r"^DECIMAL\(\d+,0\)")
    ok = {"number": number, "int": whole, "bool": found == "BOOLEAN", "text": found == "STRING"}[kind]
    if "|" in bounds:
        return ok & value.isin(*bounds.split("|"))
    if not bounds:
        return ok
    low, high = bounds[1:-1].split(",")
    n = value.try_cast("double")
    ok = ok & (n >= float(low) if bounds[0] == "[" else n > float(low))
    return ok & (n <= float(high) if bounds[-1] == "]" else n < float(high)) if high else ok


def _issue(cond: Column, level: str, section: str | Column, key: str | Column, message: str) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(cond, F.struct(F.lit(level).alias("level"), as_col(section).alias("section"), as_col(key).alias("key"), F.lit(message).alias("message")))


def _kept(doc: Column, section: str | Column, before: str, known: str) -> Column:
    """Issues of the known settings of a document or of a part of it; `before` is the path of what the keys are under."""
    told = []
    for path, kind, bounds in _lines(known):
        if kind:
            at = f"$.{path}"
            value = F.get_json_object(doc, at)
            found = F.schema_of_variant(F.try_variant_get(F.try_parse_json(doc), at, "variant"))
            own, _, key = f"{before}{path}".rpartition(".")
            told.append(_issue(value.isNotNull() & ~F.coalesce(_fits(kind, bounds, value, found), F.lit(False)), "error", own if isinstance(section, str) else section, key, _message(kind, bounds)))
    return F.filter(F.array(*told), lambda x: x.isNotNull())


def _unknown(keys: Column, section: str | Column, known: list[str]) -> Column:
    strange = F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*map(F.lit, known)).cast("array<string>"))
    return F.transform(strange, lambda k: F.struct(F.lit("warning").alias("level"), (F.lit(section) if isinstance(section, str) else section).alias("section"), k.alias("key"), F.lit("unknown key").alias("message")))


def issues(docs: DataFrame) -> DataFrame:
    """artifact, level, section, key, message: everything wrong with a settings document.  docs: artifact, json.

    A value of the wrong kind or out of range, low_threshold above high_threshold and a text that is
    no JSON object are errors; unknown keys and an alpha that has no effect are warnings.  Settings
    that are not there are not looked at; what should be a section and is none has no keys."""
    doc = F.col("json")
    number = lambda path: F.get_json_object(doc, f"$.{path}").try_cast("double")
    low, high = number("validator.policy.low_threshold"), number("validator.policy.high_threshold")
    off = F.get_json_object(doc, "$.miner.orchestrator.danger.enabled") == "false"
    both = F.array(
        _issue(low > high, "error", "validator.policy", "low_threshold", "must be at most high_threshold"),
        _issue(off & (number("miner.orchestrator.danger.alpha") > 0), "warning", "miner.orchestrator.danger", "alpha", "no effect while danger is not enabled"),
    )
    keys = lambda section: F.json_object_keys(doc if section == "root" else F.get_json_object(doc, f"$.{section}"))
    strange = [_unknown(keys(s), s, known) for s, known in sections().items()]
    domains = F.map_entries(F.from_json(F.get_json_object(doc, f"$.{DOMAINS}"), "map<string,string>"))
    named = [k for k, _, _ in _lines(OF_DOMAIN)]
    of_domain = lambda e: F.concat(_kept(e["value"], F.concat(F.lit(f"{DOMAINS}."), e["key"]), f"{DOMAINS}.", OF_DOMAIN), _unknown(F.json_object_keys(e["value"]), F.concat(F.lit(f"{DOMAINS}."), e["key"]), named))
    parts = F.flatten(F.transform(F.filter(domains, lambda e: e["value"].startswith("{")), of_domain))
    told = F.concat(_kept(doc, "", "", KNOWN), F.filter(both, lambda x: x.isNotNull()), *strange, F.coalesce(parts, F.filter(both, lambda x: F.lit(False))))
    is_json = F.coalesce(F.trim(doc).startswith("{") & F.try_parse_json(doc).isNotNull(), F.lit(False))
    torn = F.array(F.struct(F.lit("error").alias("level"), F.lit("file").alias("section"), F.lit("").alias("key"), F.lit("no settings document").alias("message")))
    return docs.select("artifact", F.inline(F.when(is_json, told).otherwise(torn)))


def documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """artifact, json of settings files (TOML); one that is missing or malformed has a null text."""
    rows = []
    for path in paths:
        try:
            with open(path, "rb") as f:
                rows.append((path, json.dumps(tomllib.load(f), default=str)))
        except (FileNotFoundError, tomllib.TOMLDecodeError):
            rows.append((path, None))
    return values(spark, rows, "artifact string, json string")
