"""Which tables and attributes belong to a migration."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadwright.functions.names import category, fold, label, order_key, same_name
from loadwright.operators.skew import lookup_join, number_rows

# System attributes that are never staged from metadata.
SYSTEM_ATTRIBUTES = (
    "createdon", "createdby", "modifiedon", "modifiedby", "createdonbehalfby", "modifiedonbehalfby",
    "owningbusinessunit", "owningteam", "owninguser", "ownerid", "statecode", "statuscode",
    "overriddencreatedon", "importsequencenumber", "timezoneruleversionnumber",
    "utcconversiontimezonecode", "versionnumber", "processid", "stageid", "traversedpath",
)

# Component types of a solution, and the solution that restricts nothing.
ENTITY_COMPONENT = 1
ATTRIBUTE_COMPONENT = 2
UNRESTRICTED = "Default"


class Membership(NamedTuple):
    """What the chosen solution of each environment contains.

    ``chosen`` lists the environments that have a specific solution; an environment that
    is missing there is unrestricted.
    """

    chosen: DataFrame
    entities: DataFrame
    attributes: DataFrame


def tables_in_scope(entities: DataFrame) -> DataFrame:
    """All tables but the link tables; an unknown flag counts as no link table."""
    return entities.where(~F.col("is_intersect").eqNullSafe(True))


def with_category(df: DataFrame, name: str = "logical_name") -> DataFrame:
    return df.withColumn("category", category(name))


def categories(tables: DataFrame) -> DataFrame:
    """Distinct categories per environment without regard to case, and their table counts."""
    return (
        with_category(tables).withColumn("category_key", order_key("category"))
        # dealt out before they are grouped: an exploded file may be one task
        .repartition("org_key", "category_key").groupBy("org_key", "category_key")
        .agg(F.min("category").alias("category"), F.count(F.lit(1)).alias("n_tables"))
        .select("org_key", "category", "n_tables")
    )


def visible_solutions(solutions: DataFrame) -> DataFrame:
    """Solutions one can choose, with the label and the place they are listed under."""
    unique, friendly = F.coalesce("unique_name", F.lit("")), F.coalesce("friendly_name", F.lit(""))
    shown = (
        solutions.where(F.col("is_visible") & F.col("parent_solution_id").isNull())
        .withColumn("label", F.concat(label(friendly, unique), F.when(F.col("is_managed"), " (managed)").otherwise("")))
        .withColumn("_others", (~same_name(unique, F.lit(UNRESTRICTED))).cast("int"))
        .withColumn("_name", order_key(friendly))
    )
    numbered = number_rows(shown, ["org_key"], ["_others", "_name", "solution_id"], "position", bounded=True)
    return numbered.select("org_key", "solution_id", "unique_name", "label", F.col("position").cast("int").alias("position"))


def chosen_solutions(visible: DataFrame, picks: DataFrame) -> DataFrame:
    """The solution each environment works with, where that restricts anything.

    ``picks`` (org_key, solution) holds remembered unique names.  Without a pick, or with
    one that is not visible, the first solution listed is taken.
    """
    remembered = picks.groupBy("org_key").agg(F.min("solution").alias("_pick"))
    listed = lookup_join(visible, remembered, ["org_key"])
    is_pick = same_name("unique_name", F.coalesce(F.nullif("_pick", F.lit("")), F.lit(UNRESTRICTED)))
    best = listed.groupBy("org_key").agg(
        F.min(F.struct((~is_pick).alias("other"), "position", "solution_id", "unique_name")).alias("best"))
    return best.where(~same_name("best.unique_name", F.lit(UNRESTRICTED))).select(
        "org_key", "best.solution_id", "best.unique_name")


def solution_membership(components: DataFrame, chosen: DataFrame) -> Membership:
    """Tables (with their behavior) and attributes of the solution chosen per environment.

    ``chosen`` has one row per environment: org_key, solution_id.  Of several rows for one
    table the lowest behavior, which includes the most, wins.
    """
    chosen = chosen.select("org_key", "solution_id")
    inside = lookup_join(
        components.where(F.col("component_type").isin(ENTITY_COMPONENT, ATTRIBUTE_COMPONENT)),
        chosen, ["org_key", "solution_id"], "left_semi")
    entities = (
        inside.where(F.col("component_type") == ENTITY_COMPONENT)
        .groupBy("org_key", F.col("object_id").alias("entity_id"))
        .agg(F.min(F.coalesce("root_behavior", F.lit(0))).alias("behavior"))
    )
    attributes = (
        inside.where(F.col("component_type") == ATTRIBUTE_COMPONENT)
        .select("org_key", F.col("object_id").alias("attribute_id")).distinct()
    )
    return Membership(chosen.select("org_key").distinct(), entities, attributes)


def in_solution(tables: DataFrame, membership: Membership | None) -> DataFrame:
    """Tables the chosen solution contains, with any behavior; all where none is chosen."""
    if membership is None:
        return tables
    chosen = membership.chosen.withColumn("_restricted", F.lit(True))
    listed = membership.entities.select("org_key", "entity_id", F.lit(True).alias("_listed"))
    marked = lookup_join(lookup_join(tables, chosen, ["org_key"]), listed, ["org_key", "entity_id"])
    return marked.where(F.col("_restricted").isNull() | F.col("_listed")).select(*tables.columns)


def find_tables(tables: DataFrame, membership: Membership | None = None, selections: DataFrame | None = None,
                in_category: str | None = None, term: str = "", checked_only: bool = False) -> DataFrame:
    """The tables a search shows: in the solution, in the category, matching the term."""
    shown = with_category(in_solution(tables, membership))
    if checked_only:
        picks = selections.where(F.col("table").isNotNull()).select("org_key", fold("table").alias("_key")).distinct()
        keyed = shown.withColumn("_key", fold("logical_name"))
        shown = lookup_join(keyed, picks, ["org_key", "_key"], "left_semi").drop("_key")
    if in_category is not None:
        shown = shown.where(same_name("category", F.lit(in_category)))
    wanted = term.strip().upper()
    if wanted:
        shown = shown.where(_contains("logical_name", wanted) | _contains("display_name", wanted))
    return shown


def _contains(name: str, upper_term: str) -> Column:
    return F.coalesce(F.upper(name).contains(upper_term), F.lit(False))


def effective_selection(orgs: DataFrame, selections: DataFrame, legacy: list[str], tables: DataFrame,
                        membership: Membership | None = None) -> DataFrame:
    """The tables picked per environment that it has and that its solution contains.

    An environment without any entry uses the ``legacy`` list; an entry without tables
    (one row, table NULL) picks nothing.  Environment keys compare without case.
    """
    known_orgs = selections.select(fold("org_key").alias("_org")).distinct()
    keyed_orgs = orgs.select("org_key", fold("org_key").alias("_org")).distinct()
    own = lookup_join(
        selections.where(F.col("table").isNotNull())
        .select(fold("org_key").alias("_org"), fold("table").alias("_key")).distinct(),
        keyed_orgs, ["_org"], "inner").select("org_key", "_key")
    fallback = sorted({name.lower() for name in legacy})
    inherited = lookup_join(keyed_orgs, known_orgs, ["_org"], "left_anti").select(
        "org_key", F.explode(F.array(*map(F.lit, fallback)).cast("array<string>")).alias("_key"))
    picks = own.unionByName(inherited)
    keyed = in_solution(tables, membership).withColumn("_key", fold("logical_name"))
    return lookup_join(keyed, picks, ["org_key", "_key"], "left_semi").select(
        "org_key", F.col("logical_name").alias("table"))


def attributes_in_scope(attributes: DataFrame, entities: DataFrame,
                        membership: Membership | None = None) -> DataFrame:
    """Attributes to stage, with the primary flags of their table.

    Left out: system attributes, attributes derived from another, names ending ``_base``.
    Under a specific solution the table must be included whole (behavior 0) or the
    attribute listed; primary id and primary name always pass.
    """
    name = F.lower("logical_name")
    own = attributes.where(
        ~name.isin(*SYSTEM_ATTRIBUTES) & F.col("attribute_of").isNull() & ~name.endswith("_base")
    ).withColumn("_table", fold("table"))
    heads = entities.select(
        "org_key", fold("logical_name").alias("_table"), "entity_id", "primary_id", "primary_name")
    flagged = lookup_join(own, heads, ["org_key", "_table"], "inner").withColumns({
        "is_primary_id": same_name("logical_name", "primary_id"),
        "is_primary_name": same_name("logical_name", "primary_name"),
    })
    kept = flagged
    if membership is not None:
        chosen = membership.chosen.withColumn("_restricted", F.lit(True))
        listed = membership.attributes.withColumn("_listed", F.lit(True))
        kept = lookup_join(flagged, chosen, ["org_key"])
        kept = lookup_join(kept, membership.entities, ["org_key", "entity_id"])
        kept = lookup_join(kept, listed, ["org_key", "attribute_id"]).where(
            F.col("_restricted").isNull() | F.col("is_primary_id") | F.col("is_primary_name")
            | F.coalesce(F.col("behavior") == 0, F.lit(False)) | F.coalesce("_listed", F.lit(False)))
    return kept.select(*attributes.columns, "is_primary_id", "is_primary_name")
