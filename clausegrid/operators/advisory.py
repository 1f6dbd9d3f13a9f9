"""Gates on what a model says: which changes it is asked about, and what of its answer is kept.

A model is a function from rows to rows that the caller supplies; nothing here calls one.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.functions import text as T
from clausegrid.operators import report

# Kinds of change a model may name; the first two are cosmetic.
CHANGE_KINDS = "typo formatting numbering_shift reference_update definition_change obligation_added obligation_removed liability_shift term_extension penalty_change governing_law_change party_change".split()
COSMETIC_KINDS = ["typo", "formatting"]
ATTEMPTS, FIRST_WAIT = 3, 0.5
#: Seconds that one call may take, and tokens of an answer where the caller sets no other number.
CALL_SECONDS, BUDGET = 180, 4096
# What a report says where nothing of substance changed, and how a recommendation is shown.
HARMLESS, RECOMMENDED = "Tidak ada perubahan substantif terdeteksi. ", "Rekomendasi: "


def route(no_model: Column, has_verdict: Column, substantive: Column, n_ids: Column) -> Column:
    """What follows triage: analysis only if a model is there, something of substance is named, and in it changes."""
    return F.when(no_model | ~has_verdict | ~substantive | (n_ids == 0), "assemble").otherwise("analyze")


def triaged(offered: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """The changes to analyse: those named, all offered ones where a verdict is missing or names none.

    offered: keys, change_id; verdicts: keys, substantive, ids.
    """
    joined = offered.join(verdicts, keys, "left")
    ids = F.coalesce("ids", F.array().cast("array<bigint>"))
    missing = F.col("substantive").isNull()
    keep = missing | (F.col("substantive") & ((F.size(ids) == 0) | F.array_contains(ids, F.col("change_id"))))
    return joined.where(keep).select(offered.columns)


def keep_valid(analyses: DataFrame, offered: DataFrame, keys: list[str], kinds: list[str] = CHANGE_KINDS) -> DataFrame:
    """Analyses of changes that were offered and of a known kind, with normalised severity."""
    kept = analyses.where(F.col("kind").isin(kinds)).join(offered.select(*keys, "change_id"), [*keys, "change_id"], "left_semi")
    return kept.withColumn("severity", T.normalize_severity(F.col("severity")))


def risky(analyses: DataFrame) -> DataFrame:
    return analyses.where(~F.col("kind").isin(COSMETIC_KINDS) & (F.col("severity") != "info"))


def recommended_actions(recommendations: DataFrame) -> DataFrame:
    """Recommendations that say what to replace and where, as replacements."""
    return recommendations.where((F.coalesce("old", F.lit("")) != "") & F.col("paragraph_index").isNotNull()).withColumn("type", F.lit("replacement"))


def build(analyses: DataFrame, recommendations: DataFrame, keys: list[str]) -> DataFrame:
    """Advisory findings: one for each recommendation, and one for each analysis that none covers.

    Recommendations may have a paragraph_index and a recommendation, which becomes evidence.
    """
    columns = [*keys, "id", "category", "change_id", "severity", "message", "confidence", "evidence", "paragraph_index"]
    has = lambda c, kind: F.col(c) if c in recommendations.columns else F.lit(None).cast(kind)
    advice = F.trim(has("recommendation", "string"))
    own = [F.when(advice != "", F.array(F.concat(F.lit(RECOMMENDED), advice))).alias("evidence"), has("paragraph_index", "bigint").cast("bigint").alias("paragraph_index")]
    none = [F.lit(None).cast("array<string>").alias("evidence"), F.lit(None).cast("bigint").alias("paragraph_index")]
    first = recommendations.select(*keys, F.concat(F.lit("advisory-risk-"), F.col("rec_no").cast("string")).alias("id"), F.lit("legal_risk").alias("category"), "change_id", T.normalize_severity(F.col("severity")).alias("severity"), "message", T.clamp01(F.col("confidence")).alias("confidence"), *own)
    open_ones = analyses.join(recommendations.select(*keys, "change_id").distinct(), [*keys, "change_id"], "left_anti")
    second = open_ones.select(*keys, F.concat(F.lit("advisory-change-"), F.col("change_id").cast("string")).alias("id"), F.lit("meaning_change").alias("category"), "change_id", "severity", F.concat(F.lit("["), F.col("kind"), F.lit("] "), F.col("message")).alias("message"), T.clamp01(F.col("confidence")).alias("confidence"), *none)
    return first.select(columns).unionByName(second.select(columns))


def placed(findings: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``findings`` (change_id, paragraph_index) with ``para_index``, their own or else the first new paragraph of their change, and its ``node_id``."""
    about = changes.select(*keys, "change_id", F.col("node_id").alias("_node"), F.get("curr_indexes", F.lit(0)).alias("_first"))
    out = findings.join(about, [*keys, "change_id"], "left")
    return out.withColumns({"para_index": F.coalesce("paragraph_index", "_first"), "node_id": F.coalesce("_node", F.lit(""))}).drop("_node", "_first", "paragraph_index")


def assemble(verified: DataFrame, advice: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """The whole report: verified findings as they are, and grounded advice below them, in report order.

    verdicts: keys, substantive, reason and no_model. Where a verdict finds nothing of substance, its advice is left out;
    one finding says so, but only if a model did look.
    """
    columns = [*keys, "id", "class", "category", "severity", "message", "confidence", "para_index", "node_id"]
    harmless = verdicts.where(~F.col("substantive"))
    kept = advice.join(harmless.select(*keys), keys, "left_anti").withColumn("class", F.lit("advisory"))
    none = F.lit("")
    told = harmless.where(~F.col("no_model")).select(*keys, none.alias("id"), F.lit("advisory").alias("class"), F.lit("meaning_change").alias("category"), F.lit("info").alias("severity"), F.concat(F.lit(HARMLESS), F.coalesce("reason", none)).alias("message"), F.lit(1.0).alias("confidence"), F.lit(None).cast("bigint").alias("para_index"), none.alias("node_id"))
    return report.ordered(verified.select(columns).unionByName(kept.select(columns)).unionByName(told), keys)


def salvage_json(text: str):
    """The JSON in a model's answer: the whole, else a fenced block, else the first balanced object or list."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    for part in (text, fenced.group(1) if fenced else None, _balanced(text)):
        if part is not None:
            try:
                return json.loads(part)
            except ValueError:
                continue
    raise ValueError("no JSON found")


def _balanced(text: str) -> str | None:
    begin = next((i for i, c in enumerate(text) if c in "{["), None)
    if begin is None:
        return None
    depth, quoted, escaped = 0, False, False
    for i, c in enumerate(text[begin:], begin):
        if quoted:
            quoted = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                return text[begin : i + 1]
    return None


def shape_of(schema) -> str:
    """The JSON shape of a StructType, as text for a prompt."""
    from pyspark.sql import types as Ty

    def value(t) -> str:
        if isinstance(t, Ty.StructType):
            return "{" + ", ".join(f'"{f.name}": {value(f.dataType)}' for f in t.fields) + "}"
        if isinstance(t, Ty.ArrayType):
            return f"[{value(t.elementType)}]"
        if isinstance(t, Ty.BooleanType):
            return "boolean"
        return "number" if isinstance(t, Ty.NumericType) else "string"

    return value(schema)


def ask(provider: Callable[[str], str], prompt: str, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep):
    """A provider's answer as JSON; failures are tried again after waits that double."""
    for k in range(attempts):
        try:
            return salvage_json(provider(prompt))
        except Exception:
            if k + 1 == attempts:
                raise
            wait(FIRST_WAIT * 2**k)


def limited(provider: Callable, seconds: float = CALL_SECONDS) -> Callable:
    """A provider whose calls fail with TimeoutError after so many seconds."""

    def call(*args):
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(provider, *args).result(timeout=seconds)
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    return call


def ask_whole(provider: Callable[[str, int], tuple[str, bool]], prompt: str, budget: int = BUDGET, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep):
    """A provider's answer as JSON; one that is cut off at ``budget`` tokens is asked for once more with twice as many.

    ``provider`` gives an answer's text and whether it was cut off; calls that fail are tried again after waits that double.
    """

    def called(tokens: int) -> tuple[str, bool]:
        for k in range(attempts - 1):
            try:
                return provider(prompt, tokens)
            except Exception:
                wait(FIRST_WAIT * 2**k)
        return provider(prompt, tokens)

    text, cut = called(budget)
    try:
        return salvage_json(text)
    except ValueError:
        if not cut:
            raise
    text, cut = called(2 * budget)
    try:
        return salvage_json(text)
    except ValueError as e:
        if cut:
            raise ValueError(f"the answer was cut off at {2 * budget} tokens too") from e
        raise


def ask_grounded(provider: Callable[[str], str], prompt: str, check: Callable[[list], list[str]], attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep):
    """An answer whose items are checked: if all are rejected, the model is asked once more with the reasons.

    ``check`` gives one reason for each rejected item of an answer, which is a list.
    """
    answer = ask(provider, prompt, attempts, wait)
    reasons = check(answer)
    if answer and len(reasons) == len(answer):
        told = "\n".join(f"#{i}: {r}" for i, r in enumerate(reasons))
        answer = ask(provider, f"{prompt}\n\nRejected:\n{told}", attempts, wait)
    return answer


def missing_tiers(keys: dict[str, str | None], tiers: list[str]) -> list[str]:
    """The tiers without a key, sorted; none is missing if a model can be used."""
    return sorted(t for t in tiers if not keys.get(t))
