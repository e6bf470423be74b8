"""Competing candidates for one amount: scored by closure and evidence, ranked, and the one to paste.

A candidate row has (keys, value, source, ord) with ``ord`` its place among
the candidates, and per sheet what it is held against: ``total`` (the printed
total), ``known`` (the sum of known lines), ``closes_income`` (whether it makes
the income identity close; null where there is none).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import whole
from ..functions.gates import Text, gated
from .ranking import best

# The evidence that a source's wording carries (the first that fits; with detail preferred second).
EVIDENCE = (
    (r"(?i)summed detail|detail lines|misc detail", 95, 100),
    (r"(?i)statement 3", 94, 97),
    (r"(?i)other deductions \(office|office\/supplies|telephone\/travel", 96, 96),
    (r"(?i)misc detail closes", 92, 92),
    (r"(?i)federal table minus slot", 93, 93),
    (r"(?i)small attachment residual", 90, 90),
    (r"(?i)comparison.*OTHER DEDUCTIONS residual", 88, 88),
    (r"(?i)Form line 20 residual", 85, 85),
    (r"(?i)comparison.*OTHER OPERATING", 82, 82),
    (r"(?i)Statement 2 \(total minus", 75, 75),
    (r"(?i)P&L reverse math|ordinary income", 72, 72),
    (r"(?i)Stmt 2 residual", 72, 72),
    (r"(?i)document-wide exclusion", 68, 68),
)
NO_EVIDENCE, CLOSURE, IDENTITY, GAP, TOLERANCE = 65, 1000, 25, -8, 1
DETAIL = r"(?i)summed detail|detail lines|other deductions \(office|office\/supplies|misc detail closes|total minus util|total minus util\/merchant|federal table minus slot|statement 3"
WEAK_RESIDUAL = r"(?i)comparison.*residual|document-wide exclusion residual|stmt 2 residual|form line 20 residual"
OFFICE = r"(?i)office\/supplies|telephone\/travel\/bank detail"
IDENTITY_SOURCE = r"(?i)total minus bank|OTHER DEDUCTIONS residual|Form line 20 residual|itemized closure|partition|stmtTOTAL|stmtInTop8"
OFFICE_DETAIL = r"(?i)other deductions \(office|office\/supplies|telephone\/travel\/bank detail"
PARTIAL = r"(?i)comparison.*OTHER DEDUCTIONS residual|document-wide exclusion residual"
# Flags, in the order in which a candidate has them; those of the income identity.
HARD_FLAGS = ("pnl_collision", "implausible", "stmt2_total_trap", "form_line_total_trap", "comparison_reject", "weak_block_closure")
CLOSES, MISSES = "pnl_identity_close", "pnl_identity_gap"


def distinct_candidates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates of one frame (keys, value, source, ord, ...), null values left out.

    A comparison read whose value a candidate before it has already is dropped.
    Rows that were dealt by the keys stay as they lie.
    """
    rows = rows.where("value is not null").withColumn("__first", F.min("ord").over(Window.partitionBy(*keys, "value")))
    later = (F.col("ord") > F.col("__first")) & gated(F.col("source")).rlike("(?i)comparison")
    return rows.where(~F.coalesce(later, F.lit(False))).drop("__first")


def united(generators: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Candidates of several frames (keys, value), one for each source, in order.

    Where one frame holds the reads of all sources, ``distinct_candidates``
    takes it as it is and scans it once.
    """
    rows = reduce(DataFrame.unionByName, [df.select(*keys, whole(F.col("value").cast("double")).alias("value"), F.lit(source).alias("source"), F.lit(i).alias("ord")) for i, (source, df) in enumerate(generators.items())])
    return distinct_candidates(rows, keys)


def evidence(source: Column | Text, detail: Column | bool = False) -> Column:
    """Points of a source's wording; ``detail`` says whether the generator prefers it as detail."""
    detail = F.lit(detail) if isinstance(detail, bool) else F.coalesce(detail, F.lit(False))
    source = gated(source)
    return F.coalesce(*[F.when(source.rlike(p), F.when(detail, preferred).otherwise(points)) for p, points, preferred in EVIDENCE], F.lit(NO_EVIDENCE))


def near(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) <= TOLERANCE, F.lit(False))


def plausible(value: Column, total: Column, known: Column) -> Column:
    """A candidate that equals the printed total is no remainder, unless it closes it."""
    size = F.abs(value)
    echo = (size == whole(total.cast("double"))) & (F.abs(F.coalesce(known, F.lit(0)) + size - total) > TOLERANCE)
    return (size == 0) | ~F.coalesce((total > 0) & echo, F.lit(False))


def no_residual(value: Column, total: Column, known: Column) -> Column:
    """A read that is the printed total, or beyond it, or the known lines themselves; one that completes the total is none of these."""
    return near(value, total) | (~near(known + value, total) & (F.coalesce(value >= total, F.lit(False)) | (F.coalesce(known >= 1, F.lit(False)) & near(F.abs(value), known))))


def scored(candidates: DataFrame, rivals: Column | None = None, detail: Column | bool = False, form_total: Column | None = None, incomplete: Column | None = None) -> DataFrame:
    """Candidates with flags, closure, evidence, score and whether they are valid.

    ``rivals`` is an array of the sheet's other amounts, ``form_total`` the
    total on the form's own line, ``incomplete`` says that the comparison
    worksheet lacks rows.  Of the flags, those of the identity do not make a
    candidate invalid; each flag comes once.
    """
    value, total, known = F.col("value"), F.col("total"), F.coalesce("known", F.lit(0))
    candidates = candidates.withColumn("__low", F.lower("source"))
    source = Text(F.col("source"), F.col("__low"))
    closure = ((total > 0) & near(known + value, total)).cast("int")
    office = (total > 0) & ((value >= total) | ((known > 0) & (known + value > total))) & source.rlike(OFFICE)
    partial = F.coalesce(incomplete, F.lit(False)) & source.rlike(PARTIAL) if incomplete is not None else F.lit(False)
    hard = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(flag)) for flag, test in zip(HARD_FLAGS, (
        F.array_contains(rivals, value) if rivals is not None else F.lit(False),
        ~plausible(value, total, known),
        near(value, total),
        near(value, form_total) if form_total is not None else F.lit(False),
        no_residual(value, total, known) | partial,
        office,
    ), strict=True)]))
    closes = F.col("closes_income")
    soft = F.array_compact(F.array(F.when(closes, F.lit(CLOSES)), F.when(~closes, F.lit(MISSES))))
    points = F.when(closes, IDENTITY).when(~closes, GAP).otherwise(0)
    out = candidates.withColumn("closure", F.coalesce(closure, F.lit(0))).withColumn("evidence", evidence(source, detail)).withColumn("hard", hard)
    return out.withColumn("score", F.col("closure") * CLOSURE + F.col("evidence") + points).withColumn("flags", F.concat("hard", soft)).withColumn("valid", F.size("hard") == 0).drop("hard", "__low")


def ranked(scored_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The winner of each sheet, a row of ``scored``; a sheet without any has none.

    Candidates stand in the order of their scores, equal ones in that of their
    generators.  One is preferred to another by closure, then as detail, then
    by evidence; of equals the later.  Valid candidates come first: those that
    close the income identity, among them exact closers.  The winner then
    gives way, in this order: a weak residual to a federal table less its
    slots; an exact subtractive residual to misc detail that closes; a sum of
    misc detail and reverse math to the preferred detail; a residual of the
    comparison to office detail, or else to a structural read, that is
    preferred to it; a total less utilities to summed lines preferred to it.
    Without a valid candidate, detail and then comparison reads are tried.

    One aggregation finds the best row of each kind, so a sheet's candidates
    are never gathered; all rest is done on one row for each sheet.
    """
    flags, valid = F.col("flags"), F.col("valid")
    free = lambda *names: ~F.arrays_overlap(flags, F.array(*map(F.lit, names)))
    own = [c for c in scored_rows.columns if c not in keys]
    says = {
        "detail": DETAIL, "federal": "(?i)federal table minus slot", "misc": "(?i)misc detail closes", "sum": "(?i)misc detail sum", "office": OFFICE_DETAIL, "structural": "(?i)total minus util|statement 3|federal table minus slot",
        "summed": "(?i)summed detail lines", "unsure": "(?i)summed detail|detail lines|misc detail closes|total minus|federal table", "compared": "(?i)comparison",
    }
    source = Text(F.col("source"), F.col("__low"))
    rows = scored_rows.withColumn("__low", F.lower("source"))
    rows = rows.select(*scored_rows.columns, *[source.rlike(p).alias(f"__{k}") for k, p in says.items()])  # asked once for each row
    of = {k: F.col(f"__{k}") for k in says}
    closes = F.array_contains(flags, CLOSES)
    preferred = [F.col("closure"), of["detail"].cast("int"), F.col("evidence"), -F.col("score"), F.col("ord")]
    first = [F.col("score"), -F.col("ord")]
    row = F.struct(*own, "__detail")
    top = lambda test, order: F.max_by(row, F.when(test, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])))
    kinds = {
        "winner": top(valid, [closes.cast("int"), *preferred]),
        "federal": top(valid & of["federal"], first),
        "misc": top(valid & of["misc"] & (F.col("closure") >= 1), first),
        "detail": top(valid & of["detail"], preferred),
        "listed": top(valid & of["detail"] & ~of["sum"], preferred),
        "office": top(valid & of["office"], first),
        "structural": top(valid & of["structural"], first),
        "summed": top(valid & of["summed"], first),
        "unsure": top(~valid & of["unsure"] & free("comparison_reject"), preferred),
        "compared": top(~valid & of["compared"] & (F.col("value") >= 1) & free("pnl_collision", "form_line_total_trap"), preferred),
    }
    best_of = rows.groupBy(*keys).agg(*[c.alias(k) for k, c in kinds.items()])
    # asked before the steps, none of which takes a winner away: a test after them would be moved here with all of them inside
    best_of = best_of.where("coalesce(winner, unsure, compared) is not null")

    at = lambda name, field: F.col(f"{name}.{field}")
    order = lambda name: F.struct(at(name, "closure"), at(name, "__detail"), at(name, "evidence"))
    rather = lambda name: F.col(name).isNotNull() & (order(name) >= order("winner"))
    won = at("winner", "source")
    steps = [
        (won.rlike(WEAK_RESIDUAL), ["federal"], False),
        (won.rlike("(?i)residual") & (at("winner", "closure") >= 1), ["misc"], False),
        (won.rlike("(?i)misc detail sum"), ["listed"], False),
        (won.rlike("(?i)P&L reverse math"), ["detail"], False),
        (won.rlike("(?i)comparison.*OTHER DEDUCTIONS residual"), ["office", "structural"], True),
        (won.rlike("(?i)total minus util"), ["summed"], True),
    ]
    for when, names, must_be_preferred in steps:
        instead = F.coalesce(*[F.when(rather(n), F.col(n)) if must_be_preferred else F.col(n) for n in names])
        best_of = best_of.withColumn("winner", F.when(when, F.coalesce(instead, F.col("winner"))).otherwise(F.col("winner")))
    chosen = best_of.withColumn("winner", F.coalesce("winner", "unsure", "compared"))
    return chosen.select(*keys, *[at("winner", c).alias(c) for c in own])


def pasted(scored_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, value, source, exact): exact closers by evidence; else the first plausible identity residual; else none."""
    flags, source = F.col("flags"), F.col("source")
    ok = ~F.arrays_overlap(flags, F.array(F.lit("pnl_collision"), F.lit("comparison_reject")))
    exact = (F.col("closure") >= 1) & ok
    identity = source.rlike(IDENTITY_SOURCE) & ~F.arrays_overlap(flags, F.array(F.lit("pnl_collision"), F.lit("implausible")))
    rows = scored_rows.withColumn("exact", exact).where(exact | identity)
    return best(rows, keys, [F.desc("exact"), F.desc(F.when(F.col("exact"), F.col("evidence"))), F.asc("ord")]).select(*keys, "value", "source", "exact")


def confidence(closure: Column, evidence_points: Column, flags: Column, source: Column) -> Column:
    """60 to 96 from closure and evidence; flags and residuals cap it."""
    base = F.when(closure >= 1, 92).otherwise(F.least(F.lit(78), 60 + whole(evidence_points / 5)))
    return F.when(F.size(flags) > 0, F.least(base, F.lit(72))).when(source.rlike("(?i)verify|residual"), F.least(base, F.lit(88))).otherwise(F.least(F.greatest(base, F.lit(70)), F.lit(96)))
