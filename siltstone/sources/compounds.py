"""Compound layer: targets, molecules and activities as tables, and what a run over targets writes; seed dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAMES_EACH = 5


def by_gene(targets: DataFrame, gene: Column, organism: str, kind: str = "SINGLE PROTEIN", species: str = "Homo sapiens", kind_col: str = "target_type") -> DataFrame:
    """Single proteins of the species of which ``gene`` (a condition on the target's components) holds."""
    return targets.where((F.col(kind_col) == kind) & (F.col(organism) == species) & gene)


def clinical_targets(activities: DataFrame, molecules: DataFrame, target: str, molecule: str, phase: str, least: int = 1) -> DataFrame:
    """Distinct targets; with ``least`` above 1 only those with a molecule of that phase or more."""
    every = activities.select(target, molecule)
    if least > 1:
        every = every.join(molecules.where(F.col(phase) >= least).select(molecule), molecule, "left_semi")
    return every.select(target).distinct()


def first_activities(activities: DataFrame, target: str, compound: str, order: list[str]) -> DataFrame:
    """One activity, the first by ``order``, for each compound of each target: the links of a run."""
    place = F.row_number().over(Window.partitionBy(target, compound).orderBy(*order))
    return activities.withColumn("_place", place).where("_place = 1").drop("_place")


def target_run(activities: DataFrame, literature: DataFrame, log: DataFrame, target: str, compound: str, order: list[str], paper: str, names: int = NAMES_EACH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a run over targets writes: links, counts (target, n_compounds, n_ids) and the papers it queues.

    A target is linked to each of its compounds by the first activity.  Papers are those of its ``names`` first compounds in
    that order, united; a paper that ``log`` has, or that several targets find, is queued once or not at all.
    ``literature`` (compound, paper) holds what a look-up of each compound's name found.
    """
    links = first_activities(activities, target, compound, order)
    place = F.row_number().over(Window.partitionBy(target).orderBy(*order, compound))
    asked = links.select(target, compound, *(c for c in order if c not in (target, compound))).withColumn("_place", place).where(F.col("_place") <= names).select(target, compound)
    # Each pair of a target and a paper once, before anything is counted or queued.
    found = asked.join(literature.select(compound, paper).distinct(), compound).select(target, paper).distinct()
    counts = links.groupBy(target).agg(F.count("*").alias("n_compounds")).join(found.groupBy(target).agg(F.count("*").alias("n_ids")), target, "left")
    queued = found.select(paper).distinct().join(log.select(paper), paper, "left_anti").withColumn("status", F.lit("queued"))
    return links, counts.withColumn("n_ids", F.coalesce("n_ids", F.lit(0))), queued


def compound_record(raw: Column) -> Column:
    """struct<chembl_id, name, max_phase, formula, weight, synonyms> of a compound's JSON; absent parts are null."""
    text = lambda path: F.get_json_object(raw, path)
    return F.struct(
        text("$.molecule_chembl_id").alias("chembl_id"), F.coalesce(text("$.pref_name"), text("$.molecule_chembl_id")).alias("name"), text("$.max_phase").try_cast("int").alias("max_phase"),
        text("$.molecule_properties.full_molformula").alias("formula"), text("$.molecule_properties.full_mwt").try_cast("double").alias("weight"),
        F.from_json(text("$.molecule_synonyms"), "array<struct<molecule_synonym:string>>")["molecule_synonym"].alias("synonyms"),
    )


def mechanisms(rows: DataFrame, target: str, wanted: Column) -> DataFrame:
    return rows.where(F.col(target) == wanted)


def topics(seed: DataFrame, most: int | None = None, name: str | None = None) -> DataFrame:
    """Seed topics (name, priority, ...) up to a priority, or of a name, case ignored."""
    rows = seed if most is None else seed.where(F.col("priority") <= most)
    return rows if name is None else rows.where(F.lower("name") == name.lower())


def targets_of(seed: DataFrame, domain: str | None = None, gene: str | None = None) -> DataFrame:
    """Seed targets (gene, biology array, ...) of a domain of biology, or of a gene."""
    rows = seed if domain is None else seed.where(F.array_contains("biology", domain))
    return rows if gene is None else rows.where(F.upper("gene") == gene.upper())


def all_genes(seed: DataFrame) -> DataFrame:
    return seed.select("gene").distinct().orderBy("gene")
