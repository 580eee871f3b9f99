"""The plan as script text: one row per statement or line, for all environments at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadwright.functions.names import fold, order_key
from loadwright.operators.layout import FIXED_COLUMNS, is_match_key
from loadwright.operators.skew import lookup_join, number_rows
from loadwright.options import PlanOptions

# The two kinds of generated tables.
STAGING, KEY_MAP = "staging", "guid"

# Wording of the target dialect.
EXISTS_GUARD = "IF OBJECT_ID(N'%s', N'U') IS NULL\nBEGIN\n%s\nEND"
DROP_FIRST = "DROP TABLE IF EXISTS %s;\n%s"
CREATE = "CREATE TABLE %s(\n%s\n);"
INDEX = ("IF NOT EXISTS (SELECT 1 FROM sys.indexes WHERE [name] = N'%s' AND [object_id] = OBJECT_ID(N'%s'))\n"
         "    CREATE NONCLUSTERED INDEX [%s] ON %s([%s]);")


def _prefix(kind: str, options: PlanOptions) -> str:
    return options.staging_prefix if kind == STAGING else options.key_map_prefix


def _full_name(kind: str, options: PlanOptions) -> Column:
    return F.concat(F.lit(f"[{options.schema_name}].[{_prefix(kind, options)}"), "schema_name", F.lit("]"))


def _planned(entities: DataFrame, batches: DataFrame, *columns: str) -> DataFrame:
    """Tables of the plan with their schema name and place."""
    heads = entities.select("org_key", fold("logical_name").alias("key"), "schema_name", "display_name")
    places = batches.select("org_key", fold("table").alias("key"), "table", *columns)
    return lookup_join(places, heads, ["org_key", "key"], "inner")


def _lines(ordinal: str, line: Column) -> Column:
    """The lines of one table in order; a table has a bounded number of columns."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(ordinal), line.alias("line"))))
    return F.transform(F.filter(listed, lambda s: s["line"].isNotNull()), lambda s: s["line"])


def create_statements(layout: DataFrame, entities: DataFrame, batches: DataFrame, kind: str = STAGING,
                      options: PlanOptions = PlanOptions()) -> DataFrame:
    """The statement that creates each table, and the file and place it belongs to.

    ``layout`` comes from ``staging_layout`` or ``key_map_layout``.
    """
    is_staging = kind == STAGING
    remark = F.col("comment") if is_staging else F.lit(None).cast("string")
    last = F.max("ordinal").alias("last")
    # the fixed columns at the end of a staging table are no match keys, whatever the suffixes
    fixed = F.lower("name").isin(*(n.lower() for n, _ in FIXED_COLUMNS)) if is_staging else F.lit(False)
    is_key = is_match_key("name", options.match_key_suffixes) & ~fixed
    definition = F.format_string("    [%s] %s" + ("" if is_staging else " NULL"), "name", "sql_type")
    comment = F.coalesce(F.concat(F.lit("    -- "), remark), F.lit(""))
    per_table = layout.groupBy("org_key", fold("table").alias("key")).agg(
        last,
        F.array_sort(F.collect_list(F.struct("ordinal", definition.alias("text"), comment.alias("comment")))).alias("cols"),
        _lines("ordinal", F.when(is_key, F.col("name"))).alias("matched"))
    planned = _planned(entities, batches, "file_no", "pos").withColumn("full_name", _full_name(kind, options))
    rows = lookup_join(planned, per_table, ["org_key", "key"], "inner")
    body = F.array_join(F.transform("cols", lambda c: F.concat(
        c["text"], F.when(c["ordinal"] < F.col("last"), ",").otherwise(""), c["comment"])), "\n")
    create = F.format_string(CREATE, F.col("full_name"), body)
    recreate = options.staging_drop_recreate if is_staging else options.key_map_drop_recreate
    statement = F.format_string(DROP_FIRST if recreate else EXISTS_GUARD, F.col("full_name"), create)
    if options.index_match_keys:
        bare = F.concat(F.lit(f"IX_{_prefix(kind, options)}"), "schema_name", F.lit("_"))
        indexes = F.transform("matched", lambda n: F.format_string(
            INDEX, F.concat(bare, n), F.col("full_name"), F.concat(bare, n), F.col("full_name"), n))
        statement = F.array_join(F.concat(F.array(statement), indexes), "\n")
    return rows.select(
        "org_key", F.format_string(f"%02d_create_{kind}.sql", "file_no").alias("file_name"), "pos", "table",
        statement.alias("statement"))


def reset_statements(entities: DataFrame, batches: DataFrame, action: str = "truncate",
                     options: PlanOptions = PlanOptions()) -> DataFrame:
    """Statements that empty (``truncate``) or drop (``teardown``) the tables, dependents first.

    Those for key maps come after the others and are commented out: they hold ids
    accumulated over many runs.
    """
    # The statement of each action.
    verb = {"truncate": "TRUNCATE TABLE", "teardown": "DROP TABLE IF EXISTS"}[action]
    planned = _planned(entities, batches, "reverse_no")

    def block(kind: str, number: int, start: str) -> DataFrame:
        return planned.select(
            "org_key", F.lit(f"{action}.sql").alias("file_name"), F.lit(number).alias("block"), "reverse_no", "table",
            F.concat(F.lit(f"{start}{verb} "), _full_name(kind, options), F.lit(";")).alias("statement"))

    return block(STAGING, 1, "").unionByName(block(KEY_MAP, 2, "-- "))


def diagram_lines(entities: DataFrame, batches: DataFrame, diagram_edges: DataFrame) -> DataFrame:
    """The flowchart of each environment, line by line: a group per tier, then the edges.

    Arrows point at the lookup target; dashed ones are deferred to the update pass.
    """
    tables = _planned(entities, batches, "tier", "order_no")
    name = F.replace(F.replace(F.replace(F.col("display_name"), F.lit('"'), F.lit("'")), F.lit("["), F.lit("(")),
                     F.lit("]"), F.lit(")"))
    node = F.format_string('        %s["%s<br/><small>%s</small>"]', F.col("table"), name, F.col("table"))
    zero, blank = F.lit(0), F.lit("")

    def lines(df: DataFrame, block: int, text: Column, tier=zero, step=zero, order=zero, name=blank) -> DataFrame:
        return df.select("org_key", F.lit(block).alias("block"), tier.alias("tier"), step.alias("step"),
                         order.alias("order_no"), name.alias("name"), text.alias("line"))

    tiers = tables.select("org_key", "tier").distinct()
    tier = F.col("tier")
    first = tables.select("org_key").distinct()
    places = tables.select("org_key", F.col("key").alias("src"), F.col("table").alias("src_name"), "order_no")
    edges = lookup_join(diagram_edges, places, ["org_key", "src"], "inner")
    arrow = F.when(F.col("status") == "kept", "-->").otherwise("-.->")
    everything = (
        lines(first, 0, F.lit("flowchart TD"))
        .unionByName(lines(tiers, 1, F.format_string('    subgraph tier%d["Tier %d"]', tier, tier), tier, F.lit(1)))
        .unionByName(lines(tables, 1, node, tier, F.lit(2), F.col("order_no")))
        .unionByName(lines(tiers, 1, F.lit("    end"), tier, F.lit(3)))
        .unionByName(lines(edges, 2, F.format_string("    %s %s %s", F.col("src_name"), arrow, F.col("dst")),
                           order=F.col("order_no"), name=order_key("dst"))))
    numbered = number_rows(everything, ["org_key"], ["block", "tier", "step", "order_no", "name"], "line_no", bounded=True)
    return numbered.select("org_key", F.lit("diagram.mmd").alias("file_name"), F.col("line_no").cast("int").alias("line_no"), "line")
