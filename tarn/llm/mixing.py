"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Token mass is added up per cell of source, language and topic. A marginal target either names categories and their shares
(`*` stands for all others), or is a power: each value is a category of its own and gets a share in proportion to that power
of its own mass, however small it is.

With `classes=False`, as the queries do it, each category is fitted to its own target. Up to DRIVER_CELLS cells (combinations
of categories that occur) are fitted on the driver, which gets four numbers a cell; a corpus with more is fitted by Spark, a
job a round, and nothing but sums comes to the driver. Both do the same steps.

With `classes=True`, the default of the general interface, the fitting is coarse: the categories of a power are put together
by the binary logarithm of their mass, at most 64 classes whatever the corpus; a class has the sum of its categories' targets,
and within it each category keeps its own weight. A class meets its target; a category in it does not if it differs from the
class in its other marginals, or if its probability is cut at 1.

KEEP is the share of all tokens that is to be taken. Each marginal's targets are its shares of that, but no category can be
asked for more than it has: what one lacks goes to the others of its marginal in proportion. Raking then scales the cells
to the source, language and topic targets in turn, a document's probability never above 1, until nothing moves by more
than PRECISION, or ROUNDS. A few documents of a rare category are therefore taken whole, and don't set the scale of all.
`marginals` reports target, expected and available mass per category, so targets that don't go together show.

Whether a document is taken depends on a hash of its id, so a rerun, and any partitioning, takes the same documents. One
aggregation with partial sums is shuffled, a row per source, language, topic and task, and staged. Its result, a row per
source, language and topic, is joined to the documents: Spark broadcasts it if it is below its threshold, else both are
shuffled.

Defined results: a null source, language or topic is a category of its own, among `*` of named targets; a category without
mass gives its share to the others. A null text has no tokens and never decides a probability, but is sampled like others
of its cell; in a cell without tokens all are taken. Rows with one id are taken or left together. Clashing extra columns are
passed on by `sample_documents`. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_table, staged_path

OTHERS = "*"
KEEP = 0.8
ROUNDS = 1000
PRECISION = 1e-12
#: Cells that the driver fits by itself.
DRIVER_CELLS = 200_000
AXES = ("source", "lang", "topic")
Marginal = dict[str, float] | float


@dataclass(frozen=True)
class Targets:
    """Shares of tokens, adding up to 1, or the power of the observed share; and the share of all tokens to be taken."""

    source: Marginal = 0.7
    lang: Marginal = 0.85
    topic: Marginal = 0.95
    keep: float = KEEP


def topic_of(text: Column) -> Column:
    """A coarse topic by form, for tables that have no topic of their own: table, noise or prose."""
    size = F.octet_length(text)  # the characters that are counted have one byte
    bars = size - F.octet_length(F.replace(text, F.lit("|"), F.lit("")))
    signs = size - F.octet_length(F.translate(text, "#*$%&<>", ""))
    return F.when(bars >= 5, "table").when(signs * 100 > size, "noise").otherwise("prose")


def token_estimate(text: Column) -> Column:
    """Tokens at four bytes each, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def feasible(shares: np.ndarray, mass: np.ndarray, total: float) -> np.ndarray:
    """total dealt by shares, no category above its mass; what one lacks goes to the others in proportion."""
    out, open_, left = np.zeros(len(mass)), mass > 0, min(total, float(mass.sum()))
    while open_.any():
        weight = np.where(open_, shares, 0.0)
        if weight.sum() <= 0:
            break
        dealt = left * weight / weight.sum()
        full = open_ & (dealt >= mass)
        if not full.any():
            return np.where(open_, dealt, out)
        out[full] = mass[full]
        left, open_ = left - float(mass[full].sum()), open_ & ~full
    return out


def rake(mass: np.ndarray, targets: list[np.ndarray], start: float = 1.0, rounds: int = ROUNDS, precision: float = PRECISION) -> np.ndarray:
    """Probabilities of the cells, 0 to 1, so that the marginals of mass x probability along each axis are the targets."""
    chance = np.where(mass > 0, min(start, 1.0), 1.0)
    for _ in range(rounds):
        before = chance
        for axis, t in enumerate(targets):
            now = (mass * chance).sum(axis=tuple(k for k in range(mass.ndim) if k != axis))
            factor = np.divide(t, now, out=np.ones_like(now), where=now > 0)
            chance = np.where(mass > 0, np.minimum(1.0, chance * factor.reshape([-1 if k == axis else 1 for k in range(mass.ndim)])), 1.0)
        if float(np.abs(chance - before).max(initial=0.0)) < precision:
            break
    return chance


def rake_cells(mass: np.ndarray, at: list[np.ndarray], targets: list[np.ndarray], start: float, rounds: int, precision: float = PRECISION) -> np.ndarray:
    """`rake` over the cells that occur: at has, for each axis, the place of each cell in the targets of that axis."""
    chance = np.where(mass > 0, min(start, 1.0), 1.0)
    for _ in range(rounds):
        before = chance
        for place, t in zip(at, targets, strict=True):
            now = np.bincount(place, mass * chance, len(t))
            factor = np.divide(t, now, out=np.ones_like(now), where=now > 0)
            chance = np.where(mass > 0, np.minimum(1.0, chance * factor[place]), 1.0)
        if float(np.abs(chance - before).max(initial=0.0)) < precision:
            break
    return chance


def _places(raw: DataFrame, axis: str, target: Marginal) -> DataFrame:
    """(value, number of its category in the fitting): of names their place from 1 on, 0 for the others; of a power one each."""
    values = raw.select(F.col(axis).alias(f"_{axis}")).distinct()
    if isinstance(target, dict):
        names = F.array(*(F.lit(k) for k in target if k != OTHERS)).cast("array<string>")
        return values.withColumn(f"{axis}_at", F.coalesce(F.array_position(names, F.col(f"_{axis}")), F.lit(0)).cast("long"))
    return stage_table(values.withColumn(f"{axis}_at", F.monotonically_increasing_id()), "mix-values")


def _named(target: dict[str, float]) -> list[float]:
    """The shares by the numbers of `_places`."""
    return [float(target.get(OTHERS, 0.0)), *(float(v) for k, v in target.items() if k != OTHERS)]


def _raked_on_driver(coarse: DataFrame, targets: Targets) -> DataFrame:
    got = coarse.toArrow()
    mass = got["n"].to_numpy()
    total, places, wanted = float(mass.sum()) * targets.keep, [], []
    for a in AXES:
        target = getattr(targets, a)
        numbers, place = np.unique(got[f"{a}_at"].to_numpy(), return_inverse=True)
        own = np.bincount(place, mass, len(numbers))
        shares = np.array(_named(target))[numbers] if isinstance(target, dict) else np.power(own, target, out=np.zeros_like(own), where=own > 0)
        places.append(place)
        wanted.append(feasible(shares, own, total))
    chance = rake_cells(mass, places, wanted, targets.keep, ROUNDS)
    return coarse.sparkSession.createDataFrame(got.drop_columns(["n"]).append_column("chance", pa.array(chance, pa.float64())))


def _wanted(coarse: DataFrame, axis: str, target: Marginal, total: float) -> DataFrame:
    """(axis number, wanted): `feasible` as the level that no category's share of it exceeds its mass."""
    own = coarse.groupBy(f"{axis}_at").agg(F.sum("n").alias("n"))
    if isinstance(target, dict):
        share = F.element_at(F.array(*map(F.lit, _named(target))), F.col(f"{axis}_at").cast("int") + 1)
    else:
        share = F.when(F.col("n") > 0, F.pow("n", F.lit(float(target)))).otherwise(0.0)
    own = stage_table(own.withColumn("share", F.when(F.col("n") > 0, share).otherwise(0.0)), "mix-wanted")
    level, before = 0.0, -1
    while True:
        full = (F.col("n") > 0) & (F.col("n") <= F.lit(level) * F.col("share"))
        sums = own.agg(F.count_if(full).alias("k"), F.sum(F.when(full, F.col("n")).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("share"))).alias("open")).first()
        if sums["k"] == before or not sums["open"]:
            return own.select(f"{axis}_at", F.least(F.col("n"), F.lit(level) * F.col("share")).alias("wanted"))
        level, before = (total - sums["full"]) / sums["open"], sums["k"]


def _raked_by_spark(coarse: DataFrame, targets: Targets) -> DataFrame:
    mass = coarse.agg(F.sum("n")).first()[0]
    total = mass * min(targets.keep, 1.0)
    wanted = {a: _wanted(coarse, a, getattr(targets, a), total) for a in AXES}
    start = F.when(F.col("n") > 0, F.lit(min(targets.keep, 1.0))).otherwise(1.0)
    cells = coarse.withColumn("chance", start)
    paths = [staged_path(coarse.sparkSession, "mix-round") for _ in range(2)]
    for k in range(ROUNDS):
        cells = cells.withColumn("was", F.col("chance"))
        for a in AXES:
            now = cells.groupBy(f"{a}_at").agg(F.sum(F.col("n") * F.col("chance")).alias("now"))
            factor = now.join(wanted[a], f"{a}_at").select(f"{a}_at", F.when(F.col("now") > 0, F.col("wanted") / F.col("now")).otherwise(1.0).alias("factor"))
            scaled = F.when(F.col("n") > 0, F.least(F.lit(1.0), F.col("chance") * F.col("factor"))).otherwise(1.0)
            cells = cells.join(factor, f"{a}_at").withColumn("chance", scaled).drop("factor")
        cells = stage_table(cells, "mix-round", paths[k % 2])
        if cells.agg(F.max(F.abs(F.col("chance") - F.col("was")))).first()[0] < PRECISION:
            break
        cells = cells.drop("was")
    return cells.select(*(f"{a}_at" for a in AXES), "chance")


def _raked(raw: DataFrame, targets: Targets) -> DataFrame:
    """source, lang, topic and probability, each category fitted to its own target, staged."""
    cells = raw
    for a in AXES:
        cells = cells.join(_places(raw, a, getattr(targets, a)), F.col(a).eqNullSafe(F.col(f"_{a}"))).drop(f"_{a}")
    cells = stage_table(cells, "mix-cells")
    keys = [f"{a}_at" for a in AXES]
    coarse = stage_table(cells.groupBy(*keys).agg(F.sum("n").cast("double").alias("n")), "mix-coarse")
    size = coarse.count()
    if not size:
        return cells.select(*AXES, F.lit(1.0).alias("probability"))
    fitted = _raked_on_driver(coarse, targets) if size <= DRIVER_CELLS else _raked_by_spark(coarse, targets)
    return stage_table(cells.join(fitted, keys).select(*AXES, F.col("chance").alias("probability")), "mix-fitted")


def _categories(raw: DataFrame, axis: str, target: Marginal) -> DataFrame:
    """For each value of an axis (value, category, factor, weight): its category in the fitting, how its probability differs
    from that of the category, and its part in the category's target."""
    values = raw.groupBy(F.col(axis).alias("value")).agg(F.sum("n").cast("double").alias("n"))
    if isinstance(target, dict):
        category = F.when(F.col("value").isin([k for k in target if k != OTHERS]), F.col("value")).otherwise(OTHERS)
        return values.select("value", category.alias("category"), F.lit(1.0).alias("factor"), F.lit(0.0).alias("weight"))
    category = F.when(F.col("n") > 0, F.floor(F.log2(F.greatest("n", F.lit(1.0)))).cast("string")).otherwise("none")
    weighed = values.select("value", "n", category.alias("category"), F.when(F.col("n") > 0, F.pow("n", F.lit(float(target)))).otherwise(0.0).alias("weight"))
    classes = weighed.groupBy("category").agg((F.sum("n") / F.sum("weight")).alias("norm"))
    factor = F.when(F.col("n") > 0, F.col("weight") / F.col("n") * F.col("norm")).otherwise(1.0)
    return weighed.join(classes, "category").select("value", "category", factor.alias("factor"), "weight")


def _cells(raw: DataFrame, targets: Targets) -> DataFrame:
    """raw (source, lang, topic, n) with the probability of each cell, staged."""
    cells = raw
    for axis in AXES:
        found = _categories(raw, axis, getattr(targets, axis)).select(F.col("value").alias(f"_{axis}"), F.col("category").alias(f"{axis}_category"), F.col("factor").alias(f"{axis}_factor"), F.col("weight").alias(f"{axis}_weight"))
        cells = cells.join(found, F.col(axis).eqNullSafe(F.col(f"_{axis}"))).drop(f"_{axis}")
    cells = stage_table(cells, "mix-cells")
    grouped = [f"{a}_category" for a in AXES]
    # As many rows as classes and names have combinations.
    coarse = cells.groupBy(*grouped).agg(F.sum("n").cast("double").alias("n")).collect()
    names = {a: sorted({r[f"{a}_category"] for r in coarse}) for a in AXES}
    mass = np.zeros([len(names[a]) for a in AXES])
    for r in coarse:
        mass[tuple(names[a].index(r[f"{a}_category"]) for a in AXES)] = r["n"]
    total = float(mass.sum()) * targets.keep
    wanted = []
    for k, a in enumerate(AXES):
        target = getattr(targets, a)
        if isinstance(target, dict):
            shares = target
        else:
            values = cells.groupBy(a, f"{a}_category").agg(F.first(f"{a}_weight").alias("w")).groupBy(f"{a}_category").agg(F.sum("w").alias("w"))
            shares = {r[f"{a}_category"]: r["w"] for r in values.collect()}  # at most 65 rows
        own = mass.sum(axis=tuple(j for j in range(3) if j != k))
        wanted.append(feasible(np.array([shares.get(c, 0.0) for c in names[a]]), own, total))
    chance = rake(mass, wanted, targets.keep)
    table = [[*(names[a][i] for a, i in zip(AXES, at, strict=True)), float(p)] for at, p in np.ndenumerate(chance)]
    schema = ", ".join(f"{g} string" for g in grouped) + ", chance double"
    fitted = cells.sparkSession.createDataFrame(table, schema)
    factor = F.col("source_factor") * F.col("lang_factor") * F.col("topic_factor")
    out = cells.join(fitted, grouped).select(*AXES, "n", F.least(F.lit(1.0), F.col("chance") * factor).alias("probability"), *grouped)
    return stage_table(out, "mix-fitted")


def _mass(values: dict[str, Column], tokens: Column, docs: DataFrame) -> DataFrame:
    rows = docs.select(*(v.cast("string").alias(k) for k, v in values.items()), tokens.alias("n"))
    return stage_table(rows.groupBy(*values).agg(F.sum("n").alias("n")), "mix-mass")


def _chosen(docs: DataFrame, values: dict[str, Column], tokens: Column, targets: Targets, seed: int, id_col: str, classes: bool) -> DataFrame:
    """docs with struct `__tarn_mix`: source, lang, topic, n_tokens, probability, selected."""
    cells = (_cells if classes else _raked)(_mass(values, tokens, docs), targets).select(F.struct(*(F.col(a).alias(a) for a in AXES)).alias("__tarn_at"), F.col("probability").alias("__tarn_p"))
    marked = docs.withColumn("__tarn_cell", F.struct(*(v.cast("string").alias(k) for k, v in values.items()), tokens.alias("n_tokens")))
    same = F.lit(True)
    for a in AXES:
        same = same & F.col(f"__tarn_cell.{a}").eqNullSafe(F.col(f"__tarn_at.{a}"))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col).isNull(), F.col(id_col)), 11).cast("double") / F.lit(float(2**53))
    out = marked.join(cells, same)
    mix = F.struct("__tarn_cell.source", "__tarn_cell.lang", "__tarn_cell.topic", "__tarn_cell.n_tokens", F.col("__tarn_p").alias("probability"), (u < F.col("__tarn_p")).alias("selected"))
    return out.select(*docs.columns, mix.alias("__tarn_mix"))


def mixed(docs: DataFrame, targets: Targets = Targets(), seed: int = 17, topic: Column | None = None, tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", classes: bool = True) -> DataFrame:  # noqa: B008
    """docs with struct `__tarn_mix`: source, lang, topic, n_tokens, probability, selected. `topic` and `tokens` are columns of
    docs that are better than the built-in estimates, such as the exact counts of the token counter. `classes=False` fits each
    category to its own target."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    values = {"source": F.col(source_col), "lang": F.col(lang_col), "topic": topic_of(text) if topic is None else topic}
    return _chosen(docs, values, token_estimate(text) if tokens is None else tokens, targets, seed, id_col, classes)


def mix_documents(docs: DataFrame, targets: Targets = Targets(), classes: bool = True) -> DataFrame:  # noqa: B008
    """Return doc_id, source, lang, topic, n_tokens, probability, selected.

    What is needed of the texts is staged, so that they are read once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stage_table(docs.select("doc_id", F.lit(None).cast("string").alias("text"), "source", "lang", topic_of(text).alias("topic"), token_estimate(text).alias("n_tokens")), "mix-rows")
    return mixed(rows, targets, topic=F.col("topic"), tokens=F.col("n_tokens"), classes=classes).select("doc_id", "__tarn_mix.*")


def sample_documents(docs: DataFrame, targets: Targets = Targets(), classes: bool = True) -> DataFrame:  # noqa: B008
    """The documents taken, all columns kept."""
    return mixed(docs, targets, classes=classes).filter("__tarn_mix.selected").select(*docs.columns)


def marginals(mixed_rows: DataFrame) -> DataFrame:
    """The report on a result of `mix_documents`: (marginal, category, available, expected) tokens of each category."""
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("marginal"), F.col(a).cast("string").alias("category")) for a in AXES))).alias("c")
    rows = mixed_rows.select(each, "n_tokens", "probability")
    return rows.groupBy("c.marginal", "c.category").agg(F.sum("n_tokens").alias("available"), F.sum(F.col("n_tokens") * F.col("probability")).alias("expected"))
