"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target number of words: all words are shared by the
sources' weights, a target stops at ``most`` times its source's words, and
the excess is shared again by weight until no target is above. The shares are
found in closed form: with sources ordered by ``cap / weight``, those below
the water line ``level`` are full and the others take ``weight * level``.

A source first takes every document in complete epochs; the rest of its
target is a weighted sample without replacement: every document draws an
exponential key divided by its quality weight, the keys are sorted within the
source, and a running sum of sizes takes documents up to the budget. Of those
left, the ones that still fit what is left of the budget are summed up and taken
in the same way, until none fits. So a source misses its target by less than the
smallest document that it leaves out, and is never above it. Keys are hashes of seed and doc_id, so reruns
agree. Running sums are dealt by range (see ``prefix``), so a hot source is
spread over many tasks.

Defined cases: null texts and empty texts have size 0 and are taken 0 words;
null sources form one source, ordered last; rows with equal doc_ids are
separate documents (equal rows share a key; the tie is broken by the text's
hash); a missing or non-positive quality weight counts as the smallest weight;
an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import running_sums
from .store import written

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 17
LEAST_QUALITY = 0.05

WORDS = r"[^\\x20\\x09-\\x0D]+"


def text_quality(text: str = "text") -> str:
    """Quality weight of a document as SQL: the share of its characters that
    are not symbols or digits, not below LEAST_QUALITY."""
    symbols = "[0-9#$%&*|@<>{}=_^~+!]"
    return (f"greatest({LEAST_QUALITY}, 1 - regexp_count(coalesce({text}, ''), '{symbols}') "
            f"/ cast(greatest(length(coalesce({text}, '')), 1) as double))")


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)`` rows."""
    sources = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    sources = written(sources.select(F.col("source").isNull().alias("last"), "source", "source_size",
                                     F.lit(1).cast("long").alias("one")), "mix-sources")
    ranked = running_sums(sources, [], ["last", "source"], ["one"])
    listed = ", ".join(str(w) for w in weights)
    ranked = ranked.selectExpr(
        "source", "source_size",
        f"cast(element_at(array({listed}), cast((one_upto - 1) % {len(weights)} as int) + 1) as long) as weight",
        f"{most} * source_size as cap")
    ranked = written(ranked.selectExpr("*", "cap / cast(weight as double) as full_at", "source is null as last"),
                     "mix-ranked")
    total, all_weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    # Sources in the order in which a rising level fills them: with the first
    # ones full, the level of the rest is what is left by weight left.
    filled = running_sums(ranked, [], ["full_at", "last", "source"], ["cap", "weight"])
    level = (filled.selectExpr(
        "full_at", f"({total or 0} - (cap_upto - cap)) / cast({all_weight or 0} - (weight_upto - weight) as double) "
                   "as level")
        .where("level <= full_at").agg(F.min(F.struct("full_at", "level")).alias("x")).select("x.level").first())
    reached = "double('infinity')" if level is None or level[0] is None else f"double('{level[0]!r}')"
    return ranked.selectExpr(
        "source", "source_size",
        f"case when full_at <= {reached} then cast(cap as double) else weight * {reached} end as target")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[int] = WEIGHTS, most: int = MOST, quality: Column | None = None,
        seed: int = SEED) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` for every row;
    ``taken`` counts words, repeats included: ``taken / size`` copies of the
    document go into the mix."""
    weight = F.expr(text_quality(f"`{text}`")) if quality is None else F.greatest(
        F.coalesce(quality.cast("double"), F.lit(0.0)), F.lit(LEAST_QUALITY))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))).cast("binary"))
    uniform = (F.conv(F.substring(draw, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    sized = written(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
        F.expr(f"cast(regexp_count(coalesce(`{text}`, ''), '{WORDS}') as long)").alias("size"),
        (-F.log(uniform) / weight).alias("key"),
        F.xxhash64(F.col(text)).alias("tie")), "mix-sized")
    targets = written(source_targets(sized, weights, most), "mix-targets")
    plan = targets.selectExpr(
        "source as of_source", "source_size", "target",
        f"cast(least({most}, floor(case when source_size > 0 then target / source_size else 0 end)) as long) as epochs")
    plan = written(plan.selectExpr("*", "target - epochs * source_size as budget"), "mix-plan")
    chosen = _chosen(sized, plan.selectExpr("of_source", "budget"))
    # One row per source, and a source may hold any share of the rows: adaptive
    # execution splits its partitions, since both sides come from an exchange.
    joined = chosen.join(plan.drop("budget"), chosen["source"].eqNullSafe(plan["of_source"]))
    copies = F.least(F.lit(most).cast("long"), F.col("epochs") + F.col("again").cast("long"))
    return joined.select("doc_id", "source", "size", "source_size", "target",
                         (copies * F.col("size")).cast("long").alias("taken"))


_ORDER = ["key", "doc_id", "tie", "size"]


def _chosen(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """``sized`` with ``again``: whether a row is in the partial epoch of its
    source. ``budgets`` has ``(of_source, budget)``.

    A round is one set of running sums over the rows that fit what is left, all
    sources at once; what is left falls below a row's size in every round, so the
    rounds are about as many as the sizes have binary orders."""
    done, left, budgets = [], sized, written(budgets, "mix-budgets")
    while True:
        met = left.join(budgets, left["source"].eqNullSafe(budgets["of_source"]))
        fits = met.where("size <= budget").select(*sized.columns, "budget")
        done.append(met.where("size > budget or budget is null").select(*sized.columns, F.lit(False).alias("again")))
        placed = written(running_sums(fits, ["source"], _ORDER, ["size"]), "mix-placed")
        taken = placed.where("size_upto <= budget")
        left = placed.where("size_upto > budget").select(*sized.columns)
        done.append(taken.select(*sized.columns, F.lit(True).alias("again")))
        if left.isEmpty():
            break
        spent = taken.groupBy("source").agg(F.sum("size").alias("spent")).withColumnRenamed("source", "spent_by")
        budgets = written(budgets.join(spent, budgets["of_source"].eqNullSafe(spent["spent_by"]), "left").selectExpr(
            "of_source", "budget - coalesce(spent, 0) as budget"), "mix-budgets")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return written(out, "mix-chosen")
