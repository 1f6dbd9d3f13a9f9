"""Numbering checks and the renumbering plan over a generic table of sequences.

A sequence table has key columns, a position that orders the members of a key, and ``ordinal``,
``kind`` and ``form`` of each. Checks look at keys with two members at least. All of it is window
functions over one partitioning by key, so a plan shuffles its input once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegrid.functions import numerals

DUPLICATE, BAD_START, OUT_OF_ORDER, GAP, MIXED = "numbering_duplicate", "numbering_bad_start", "numbering_out_of_order", "numbering_gap", "numbering_mixed_form"
#: Members that a plan's summary lists.
SHOWN = 12


def with_context(sequences: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Adds n (members of the key), seq (place from 1), before (the ordinal ahead), holder (position of the ordinal's first member) and times (which member with that ordinal)."""
    whole = Window.partitionBy(*keys)
    order = whole.orderBy(pos)
    same = Window.partitionBy(*keys, "ordinal").orderBy(pos)
    return sequences.withColumns({
        "n": F.count("*").over(whole),
        "seq": F.row_number().over(order),
        "before": F.lag("ordinal").over(order),
        "before_pos": F.lag(pos).over(order),
        "before_number": F.lag("number").over(order) if "number" in sequences.columns else F.lit(None).cast("string"),
        "holder": F.first(pos).over(same),
        "times": F.row_number().over(same),
    })


def missing(before: Column, ordinal: Column, kind: Column) -> Column:
    """The ordinals that a gap leaves out, as the list writes them, comma-joined."""
    inside = F.sequence(before + 1, ordinal - 1)
    return F.when(ordinal > before + 1, F.array_join(F.transform(inside, lambda n: numerals.format_ordinal(kind, n)), ", "))


def findings(sequences: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """One row for each defect: keys, position, ``check_seq`` (the order of the checks), category, severity, ordinal, before, missing, holder."""
    c = with_context(sequences, keys, pos).where("n > 1")
    has_kind = "kind" in sequences.columns
    kind = F.col("kind") if has_kind else F.lit("DIGIT")
    made = lambda test, seq, category, severity: F.when(test, F.struct(F.lit(seq).alias("check_seq"), F.lit(category).alias("category"), F.lit(severity).alias("severity")))
    found = F.array(
        made(F.col("times") > 1, 1, DUPLICATE, "major"),
        made((F.col("seq") == 1) & (F.col("ordinal") != 1), 2, BAD_START, "minor"),
        made(F.col("ordinal") < F.col("before"), 3, OUT_OF_ORDER, "major"),
        made(F.col("ordinal") > F.col("before") + 1, 3, GAP, "major"),
    )
    out = c.withColumn("x", F.explode(F.filter(found, lambda x: x.isNotNull())))
    extra = [k for k in sequences.columns if k not in (*keys, pos, "ordinal")]
    return out.select(*keys, pos, "x.check_seq", "x.category", "x.severity", "ordinal", "before", "before_pos", "before_number", "holder", "seq", F.when(F.col("x.category") == GAP, missing(F.col("before"), F.col("ordinal"), kind)).alias("missing"), *extra)


def mixed_forms(sequences: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Keys whose members are written in several forms, with the forms in order of first use."""
    first = sequences.groupBy(*keys, "form").agg(F.min(pos).alias("at"), F.count("*").alias("members"))
    forms = first.groupBy(*keys).agg(F.sum("members").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "form"))), lambda x: x["form"]), ", ").alias("forms"), F.count("*").alias("n_forms"))
    return forms.where("n > 1 and n_forms > 1").select(*keys, F.lit(MIXED).alias("category"), F.lit("minor").alias("severity"), "forms")


def prefix_mismatches(clauses: DataFrame) -> DataFrame:
    """Clauses (number, parent_number) whose first part is not their article's number."""
    first = F.regexp_extract("number", r"^([0-9]+)\.", 1)
    got = first.try_cast("int").cast("string")
    return clauses.where((first != "") & (got != F.col("parent_number"))).select(*clauses.columns, got.alias("got"), F.lit(BAD_START).alias("category"), F.lit("major").alias("severity"))


def plan(sequences: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """Every member with its place as target and, where it differs, what the text would say instead.

    Adds target, old_text, new_text (null where nothing changes).
    """
    target = F.row_number().over(Window.partitionBy(*keys).orderBy(pos))
    kind = F.col("kind") if "kind" in sequences.columns else F.lit("DIGIT")
    form = F.col("form") if "form" in sequences.columns else F.lit("BARE")
    old = F.col("raw") if "raw" in sequences.columns else numerals.render(kind, form, F.col("ordinal"))
    out = sequences.withColumn("target", target)
    return out.withColumns({"old_text": old, "new_text": F.when(F.col("ordinal") != F.col("target"), numerals.render(kind, form, F.col("target")))})


def first_actions(planned: DataFrame, paragraph: list[str], order: list[str]) -> DataFrame:
    """At most one action a paragraph: the first in ``order``."""
    rank = F.row_number().over(Window.partitionBy(*paragraph).orderBy(*order))
    return planned.where("new_text is not null").withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def apply_plan(planned: DataFrame) -> DataFrame:
    """The sequences as they would be once the plan is carried out."""
    return planned.withColumn("ordinal", F.col("target"))


def summary(planned: DataFrame, keys: list[str], pos: str = "pos", shown: int = SHOWN) -> DataFrame:
    """For each key with a change: fixes, and the first members before and after, comma-joined."""
    rows = planned.groupBy(*keys).agg(F.count("new_text").alias("fixes"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(pos, "old_text", F.coalesce("new_text", "old_text").alias("new")))).alias("x"))
    dots = F.when(F.col("n") > shown, ", …").otherwise("")
    joined = lambda f: F.concat(F.array_join(F.transform(F.slice("x", 1, shown), lambda m: m[f]), ", "), dots)
    return rows.where("fixes > 0").select(*keys, "fixes", joined("old_text").alias("before"), joined("new").alias("after"))
