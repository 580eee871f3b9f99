"""The same results as SQL over the given tables, for DuckDB."""

from __future__ import annotations

from workloads import fleet
from workloads.fleet import literal
from workloads.queries import BATCH_SIZE, LOADS, TPCH_EDGES, TPCH_TABLES

# System attributes that are never staged from metadata, written out again as a check of the operator's.
SYSTEM_ATTRIBUTES = (
    "createdon", "createdby", "modifiedon", "modifiedby", "createdonbehalfby", "modifiedonbehalfby",
    "owningbusinessunit", "owningteam", "owninguser", "ownerid", "statecode", "statuscode",
    "overriddencreatedon", "importsequencenumber", "timezoneruleversionnumber",
    "utcconversiontimezonecode", "versionnumber", "processid", "stageid", "traversedpath",
)


def values(rows, names: str) -> str:
    def item(v):
        return f"[{', '.join(map(literal, v))}]::VARCHAR[]" if isinstance(v, tuple) else literal(v)

    body = ", ".join(f"({', '.join(map(item, row))})" for row in rows)
    return f"(VALUES {body}) AS v({names})"


# ---------------------------------------------------------------- inputs

CUSTOMERS = "customers AS (SELECT CAST(c_custkey AS VARCHAR) AS org_key, c_custkey AS key FROM customer)"
SUPPLIERS = "suppliers AS (SELECT CAST(s_suppkey AS VARCHAR) AS org_key, s_suppkey AS key FROM supplier)"

ENTITIES = f"""{CUSTOMERS},
entities AS (
  SELECT org_key, key, org_key || '|' || logical_name AS entity_id, logical_name, position,
         upper(logical_name[1]) || lower(logical_name[2:]) AS schema_name,
         CASE WHEN display = '' THEN logical_name ELSE display END AS display_name, link,
         CASE WHEN position('_' IN logical_name) > 1 THEN split_part(logical_name, '_', 1) ELSE 'oob' END AS category
  FROM customers, {values([(*t, i) for i, t in enumerate(fleet.CRM_TABLES)], 'logical_name, display, link, position')}),
scoped AS (SELECT * FROM entities WHERE link IS DISTINCT FROM true),
in_solution AS (SELECT * FROM scoped WHERE key % 2 = 1 OR (key + position) % 3 != 0),
picks AS (
  SELECT org_key, key, lower(name) AS pick
  FROM customers, {values([(n, i) for i, n in enumerate(('account', 'LEAD', 'x_case', 'x_survey', 'nowhere'))],
                          'name, place')}
  WHERE key % 5 >= 2 AND place <= key % 5)"""

_attributes = [(*a, i) for i, a in enumerate(fleet.CASE_ATTRIBUTES)]
ATTRIBUTES = f"""{SUPPLIERS},
listed AS (
  SELECT org_key, key, name, attr_type, max_length, date_format, multi, targets, attribute_of
  FROM suppliers, {values(fleet.CASE_ATTRIBUTES,
                          'name, attr_type, max_length, date_format, multi, targets, attribute_of')}
  UNION ALL
  SELECT org_key, key, 'x_vary', 'String', key * 45, NULL, NULL, NULL, NULL FROM suppliers),
attributes AS (
  SELECT org_key, key, 'x_case' AS "table", org_key || '|' || name AS attribute_id, name AS logical_name, attr_type,
         attribute_of, CAST(max_length AS INTEGER) AS max_length, date_format, multi AS is_multi_select, targets,
         CASE WHEN name IN ('x_zero', 'x_notes') THEN '' ELSE 'Label ' || name END AS display_name,
         CASE WHEN name = 'x_title' THEN 'about the title' ELSE '' END AS description,
         starts_with(name, 'x_') AS is_custom
  FROM listed),
scoped AS (
  SELECT *, logical_name = 'x_caseid' AS is_primary_id, logical_name = 'x_title' AS is_primary_name
  FROM attributes
  WHERE lower(logical_name) NOT IN ({', '.join(map(literal, SYSTEM_ATTRIBUTES))})
    AND attribute_of IS NULL AND NOT ends_with(lower(logical_name), '_base'))"""

TYPED = f"""{ATTRIBUTES},
typed AS (
  SELECT org_key, "table", logical_name AS name,
         CASE attr_type
           WHEN 'String' THEN CASE WHEN coalesce(max_length, 100) BETWEEN 1 AND 4000
                                   THEN 'NVARCHAR(' || coalesce(max_length, 100) || ')' ELSE 'NVARCHAR(MAX)' END
           WHEN 'Memo' THEN 'NVARCHAR(MAX)'
           WHEN 'Integer' THEN 'INT' WHEN 'BigInt' THEN 'BIGINT' WHEN 'Boolean' THEN 'BIT'
           WHEN 'DateTime' THEN CASE WHEN date_format = 'DateOnly' THEN 'DATE' ELSE 'DATETIME2(7)' END
           WHEN 'Uniqueidentifier' THEN CASE WHEN is_primary_id THEN 'NVARCHAR(100)' END
           WHEN 'Virtual' THEN CASE WHEN is_multi_select THEN 'NVARCHAR(MAX)' END
           ELSE CASE WHEN attr_type IN ('Decimal', 'Double', 'Money', 'Picklist', 'Lookup', 'Customer', 'Owner')
                     THEN 'NVARCHAR(100)' END
         END AS sql_type,
         attr_type IN ('Lookup', 'Customer', 'Owner') AS is_lookup,
         attr_type IN ('Lookup', 'Customer', 'Owner') AND len(coalesce(targets, [])) != 1 AS is_polymorphic,
         CASE WHEN attr_type IN ('Lookup', 'Customer', 'Owner') THEN targets END AS targets,
         attr_type = 'Uniqueidentifier' AND is_primary_id AS is_primary_id,
         attr_type = 'String' AND is_primary_name AS is_primary_name,
         false AS is_type_companion, display_name, description, attr_type,
         CASE WHEN attr_type = 'String' THEN 'Max length: ' || coalesce(max_length, 100)
              WHEN attr_type = 'Memo' AND max_length IS NOT NULL THEN 'Max length: ' || max_length
              WHEN attr_type = 'DateTime' AND date_format = 'DateOnly' THEN 'Format: DateOnly'
              WHEN attr_type = 'DateTime' THEN 'Format: DateAndTime'
              ELSE '' END AS additional_info,
         is_custom
  FROM scoped WHERE attr_type IS NOT NULL),
mapped AS (SELECT * FROM typed WHERE sql_type IS NOT NULL)"""

COLUMNS = f"""{TYPED},
columns AS (
  SELECT * FROM mapped
  UNION ALL
  SELECT org_key, "table", name || '_base', 'NVARCHAR(100)', false, false, NULL, false, false, false,
         display_name || ' (Base)', '', 'Money', 'generated base-currency companion', is_custom
  FROM mapped WHERE attr_type = 'Money'
  UNION ALL
  SELECT org_key, "table", name || 'type', 'NVARCHAR(100)', false, false, NULL, false, false, true, '', '',
         'EntityName', 'generated target-table companion for ' || name, is_custom
  FROM mapped WHERE is_polymorphic)"""

KEY_MAP = """
heads AS (
  SELECT org_key, "table", name, CASE WHEN is_primary_id THEN 'VARCHAR(100)' ELSE sql_type END AS sql_type,
         CASE WHEN is_primary_id THEN 1 ELSE 2 END AS block
  FROM columns WHERE is_primary_id OR is_primary_name
  UNION ALL
  SELECT org_key, "table", name, sql_type, 3 FROM columns WHERE {match}
  UNION ALL
  SELECT org_key, "table", name, 'NVARCHAR(100)', 4 FROM columns WHERE is_lookup OR is_type_companion),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY org_key, "table", upper(name) ORDER BY block) AS copy FROM heads)"""

SOLUTION_ROWS = f"""{SUPPLIERS},
components AS (
  SELECT org_key, key, solution, org_key || '|' || object AS object_id, type, behavior
  FROM (
    SELECT org_key, key, 'zeta' AS solution, 'x_case' AS object, 1 AS type,
           CASE key % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS behavior FROM suppliers
    UNION ALL
    SELECT org_key, key, 'zeta', 'x_case', 1, CASE key % 4 WHEN 1 THEN 2 WHEN 2 THEN 1 END FROM suppliers
    UNION ALL
    SELECT org_key, key, solution, object, type, NULL
    FROM suppliers, (VALUES ('zeta', 'x_legacyid', 2), ('zeta', 'customerid', 2), ('zeta', 'x_fee', 2),
                            ('zeta', 'x_form', 60), ('zeta', 'x_odd', NULL), ('beta', 'x_count', 2))
                    AS v(solution, object, type))
  WHERE NOT (coalesce(type, 0) = 1 AND key % 4 = 3))"""

_variants = [(v, t, tier) for v, (tiers, _) in enumerate(fleet.CRM_TIERS) for t, tier in zip(fleet.CRM_PLANNED, tiers)]
_given_up = [(v, *e.split()) for v, (_, dropped) in enumerate(fleet.CRM_TIERS) for e in dropped]
PLAN = f"""{CUSTOMERS},
tiers AS (
  SELECT org_key, name AS "table", CAST(tier AS INTEGER) AS tier
  FROM customers JOIN {values(_variants, 'variant, name, tier')} ON key % {len(fleet.CRM_TIERS)} = variant),
dropped AS (
  SELECT org_key, src, dst
  FROM customers JOIN {values(_given_up, 'variant, src, dst')} ON key % {len(fleet.CRM_TIERS)} = variant),
edges AS (
  SELECT DISTINCT org_key, source AS src, target AS dst
  FROM customers, {values(fleet.CRM_LOOKUPS, 'source, name, target, edge')}
  WHERE edge IS NOT NULL AND edge != key % {len(fleet.CRM_TIERS)})"""

BATCHES = f"""{PLAN},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY org_key, tier ORDER BY upper("table")) - 1 AS rn,
         count(*) OVER (PARTITION BY org_key, tier) AS n FROM tiers),
parted AS (
  SELECT *, rn // {BATCH_SIZE} + 1 AS part, (n + {BATCH_SIZE - 1}) // {BATCH_SIZE} AS total_parts,
         rn % {BATCH_SIZE} + 1 AS pos FROM ranked),
batches AS (
  SELECT org_key, CAST(dense_rank() OVER (PARTITION BY org_key ORDER BY tier, part) AS INTEGER) AS file_no, tier,
         CAST(part AS INTEGER) AS part, CAST(total_parts AS INTEGER) AS total_parts, CAST(pos AS INTEGER) AS pos,
         "table",
         'tier ' || tier || CASE WHEN total_parts > 1 THEN ' pt ' || part || '/' || total_parts ELSE '' END || ', '
           || count(*) OVER (PARTITION BY org_key, tier, part)
           || CASE WHEN count(*) OVER (PARTITION BY org_key, tier, part) = 1 THEN ' table' ELSE ' tables' END AS label,
         CAST(row_number() OVER (PARTITION BY org_key ORDER BY tier, part, pos) AS INTEGER) AS order_no,
         CAST(row_number() OVER (PARTITION BY org_key ORDER BY tier DESC, part DESC, pos DESC) AS INTEGER) AS reverse_no
  FROM parted)"""

_names = "[" + ", ".join(map(literal, fleet.GRAPH_NAMES)) + "]"
# One row per environment; every step of the recursion is one round of the documented rule.
GRAPHS = f"""pairs AS (
  SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS org_key,
         lower({_names}[o_orderkey % {len(fleet.GRAPH_NAMES)} + 1]) AS src,
         lower({_names}[dayofmonth(o_orderdate) % {len(fleet.GRAPH_NAMES)} + 1]) AS dst
  FROM orders),
edges AS (SELECT * FROM pairs WHERE src != dst),
members AS (
  SELECT org_key, lower(unnest({_names})) AS t FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS org_key FROM orders)),
nodes AS (
  SELECT m.org_key, m.t, coalesce(list(e.dst) FILTER (WHERE e.dst IS NOT NULL), []) AS unmet
  FROM members m LEFT JOIN edges e ON m.org_key = e.org_key AND m.t = e.src GROUP BY ALL),
steps AS (
  SELECT org_key, list({{'t': t, 'unmet': unmet, 'tier': 0}}) AS pending,
         []::STRUCT(t VARCHAR, tier INTEGER)[] AS placed, []::STRUCT(src VARCHAR, dst VARCHAR)[] AS given_up
  FROM nodes GROUP BY org_key
  UNION ALL
  SELECT org_key,
    CASE WHEN len(free) > 0 THEN
      list_transform(list_filter(pending, lambda p: len(p.unmet) > 0), lambda p: {{
        't': p.t,
        'unmet': list_filter(p.unmet, lambda d: NOT list_contains(list_transform(free, lambda f: f.t), d)),
        'tier': greatest(p.tier, coalesce(list_max(list_transform(
          list_filter(free, lambda f: list_contains(p.unmet, f.t)), lambda f: f.tier + 1)), 0))}})
    ELSE list_transform(pending, lambda p: {{
        't': p.t, 'unmet': CASE WHEN p.t = hub THEN []::VARCHAR[] ELSE p.unmet END, 'tier': p.tier}}) END,
    list_concat(placed, list_transform(free, lambda f: {{'t': f.t, 'tier': f.tier}})),
    CASE WHEN len(free) > 0 THEN given_up ELSE list_concat(given_up, list_transform(
      list_filter(pending, lambda p: p.t = hub)[1].unmet, lambda d: {{'src': hub, 'dst': d}})) END
  FROM (
    SELECT *, list_filter(pending, lambda p: len(p.unmet) = 0) AS free,
           list_sort(list_transform(pending, lambda p: {{
             'waiting': -len(list_filter(pending, lambda q: list_contains(q.unmet, p.t))),
             'unmet': len(p.unmet), 'name': upper(p.t), 't': p.t}}))[1].t AS hub
    FROM steps WHERE len(pending) > 0)),
ended AS (SELECT * FROM steps WHERE len(pending) = 0)"""


def _reset(verb: str, file: str, schema: str) -> str:
    shown = "upper(\"table\"[1]) || lower(\"table\"[2:])"
    return f"""WITH {BATCHES}
        SELECT org_key, '{file}' AS file_name, CAST(1 AS INTEGER) AS block, reverse_no, "table",
               '{verb} [{schema}].[stage_' || {shown} || '];' AS statement FROM batches
        UNION ALL
        SELECT org_key, '{file}', CAST(2 AS INTEGER), reverse_no, "table",
               '-- {verb} [{schema}].[guid_' || {shown} || '];' FROM batches"""


def _md5(table: str, key: str) -> str:
    return f"md5('{table}|' || CAST({key} AS VARCHAR))"


def _loaded_lookups() -> str:
    """Every lookup of every given table, resolved."""
    parts = []
    for table, (names, lookups) in LOADS.items():
        for column, target in lookups.items():
            key = LOADS[target][0][0]
            parts.append(
                f"SELECT '{table}' AS \"table\", CAST(a.{names[0]} AS VARCHAR) AS row_key, '{column}' AS lookup, "
                f"CAST(a.{column} AS VARCHAR) AS legacy_key, {_md5(target, f'b.{key}')} AS resolved_id, "
                f"CASE WHEN b.{key} IS NULL THEN 'unresolved' ELSE 'resolved' END AS status "
                f"FROM {table} a LEFT JOIN {target} b ON a.{column} = b.{key}")
    return "\nUNION ALL\n".join(parts)


def _catalog_load() -> str:
    """Lookups of the loaded shop, the dictionary of every region's shop, and the kinds of output that were asked for."""
    def link(table: str, key: str, column: str, value: str, target: str, found: str, rows: str) -> str:
        return (f"SELECT '{table}' AS name, CAST({key} AS VARCHAR) AS row_key, '{column}' AS item, "
                f"md5({target} || '|' || CAST({found} AS VARCHAR)) AS value, CASE WHEN {value} IS NULL THEN 'empty' "
                f"WHEN {found} IS NULL THEN 'unresolved' ELSE 'resolved' END AS status FROM {rows}")

    first = ("(SELECT o_custkey AS k, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS c_first FROM orders GROUP BY o_custkey)")
    before = ("(SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS o_before "
              "FROM orders)")
    owner = "CASE WHEN event_type IN ('purchase', 'signup') THEN 'customer' ELSE 'supplier' END"
    parts = [
        link("nation", "n_nationkey", "n_regionkey", "n_regionkey", "'region'", "r_regionkey",
             "nation LEFT JOIN region ON n_regionkey = r_regionkey"),
        link("customer", "c_custkey", "c_nationkey", "c_nationkey", "'nation'", "n_nationkey",
             "customer LEFT JOIN nation ON c_nationkey = n_nationkey"),
        link("supplier", "s_suppkey", "s_nationkey", "s_nationkey", "'nation'", "n_nationkey",
             "supplier LEFT JOIN nation ON s_nationkey = n_nationkey"),
        link("customer", "c_custkey", "c_first", "c_first", "'orders'", "c_first", f"customer LEFT JOIN {first} ON c_custkey = k"),
        link("orders", "o_orderkey", "o_custkey", "o_custkey", "'customer'", "c_custkey",
             "orders LEFT JOIN customer ON o_custkey = c_custkey"),
        link("orders", "o_orderkey", "o_before", "o_before", "'orders'", "o_before", before),
        link("events", "event_id", "owner", "user_id", owner,
             f"CASE WHEN {owner} = 'customer' THEN c_custkey ELSE s_suppkey END",
             "events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN supplier ON user_id = s_suppkey"),
    ]
    # How the types of the shop's attributes are staged.
    kinds = {"String": "NVARCHAR(100)", "Lookup": "NVARCHAR(100)", "Customer": "NVARCHAR(100)", "DateTime": "DATETIME2(7)"}
    columns = [(t, a, kinds[kind], ", ".join(targets) if targets else None) for t, attributes in fleet.SHOP_TABLES
               for a, kind, targets in attributes]
    columns.append(("events", "ownertype", "NVARCHAR(100)", None))
    parts.append("SELECT name, trim(r_name) AS row_key, item, value, status FROM region, "
                 + values(columns, "name, item, value, status"))
    parts.append("SELECT unnest(['key_maps', 'truncate', 'dictionary']) AS name, NULL AS row_key, NULL AS item, NULL AS value, "
                 "NULL AS status")
    return " UNION ALL ".join(parts)


def _counts_after_reset() -> str:
    parts = []
    for table, (names, _) in LOADS.items():
        parts.append(f"SELECT '{table}' AS \"table\", 'staging' AS kind, CAST(0 AS BIGINT) AS n_rows")
        parts.append(f"SELECT '{table}', 'key_map', count(DISTINCT {names[0]}) FROM {table}")
    return "\nUNION ALL\n".join(parts)


def _profile() -> str:
    columns = (
        ("O_CustKey", "NVARCHAR(100)", "CAST(o_custkey AS VARCHAR)"),
        ("o_orderdate", "DATETIME2(7)", "CAST(o_orderdate AS VARCHAR)"),
        ("o_orderkey", "NVARCHAR(100)", "CAST(o_orderkey AS VARCHAR)"),
        ("o_orderpriority", "NVARCHAR(15)", "o_orderpriority"),
        ("o_orderstatus", "NVARCHAR(100)", "o_orderstatus"),
        ("o_remark", "NVARCHAR(MAX)", "CAST(NULL AS VARCHAR)"),
        ("o_totalprice", "NVARCHAR(100)", "CAST(CAST(o_totalprice AS DECIMAL(38, 2)) AS VARCHAR)"),
        ("overriddencreatedon", "DATETIME2(7)", "CAST(NULL AS VARCHAR)"),
        ("ownerid", "NVARCHAR(100)", "CAST(NULL AS VARCHAR)"),
        ("owneridtype", "NVARCHAR(100)", "CAST(NULL AS VARCHAR)"),
        ("statecode", "INT", "CAST(NULL AS VARCHAR)"),
    )
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS name, '{kind}' AS sql_type, count(*) AS n_rows, count(*) - count({e}) AS n_null, "
        f"count(DISTINCT {e}) AS n_distinct, CAST(max(length({e})) AS INTEGER) AS max_length FROM orders"
        for name, kind, e in columns)


RESOLVED_ORDERS = f"""
  SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
         CASE WHEN o_custkey % 10 != 0 THEN {_md5('customer', 'c_custkey')} END AS o_custkey_id,
         CASE WHEN o_custkey % 10 != 0 AND c_custkey IS NOT NULL THEN 'resolved' ELSE 'unresolved' END
           AS o_custkey_status
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""

_chain_edges = values([tuple(e.split()) for e in TPCH_EDGES], "src, dst")
_chain_tables = values([(t,) for t in TPCH_TABLES], "name")

ORACLE: dict[str, str] = {
    "flatten_entities": f"""WITH {SUPPLIERS}
        SELECT org_key, org_key || '|x_case' AS entity_id, 'x_case' AS logical_name, 'x_Case' AS schema_name,
               CASE WHEN key % 2 = 0 THEN 'Case' ELSE 'x_case' END AS display_name, 'Cases' AS plural_name,
               '' AS description, 'x_caseid' AS primary_id, 'x_title' AS primary_name,
               CAST(10042 AS INTEGER) AS object_type_code, true AS is_custom, false AS is_intersect,
               'UserOwned' AS ownership, '1.0' AS introduced_version FROM suppliers""",
    "flatten_attributes": f"""WITH {ATTRIBUTES}
        SELECT org_key, "table", attribute_id, logical_name, attr_type, attribute_of, max_length, date_format,
               is_multi_select, CASE WHEN len(targets) = 0 THEN '' ELSE array_to_string(targets, ',') END AS targets,
               display_name, description, is_custom FROM attributes""",
    "flatten_targets": f"""WITH {ATTRIBUTES}
        SELECT org_key, "table", logical_name, CAST(unnest(range(len(targets))) AS INTEGER) AS position,
               unnest(targets) AS target FROM attributes WHERE len(targets) > 0""",
    "tables_in_scope": f"WITH {ENTITIES} SELECT org_key, logical_name, display_name FROM scoped",
    "table_categories": f"WITH {ENTITIES} SELECT org_key, logical_name, category FROM entities",
    "category_counts": f"""WITH {ENTITIES}
        SELECT org_key, min(category) AS category, count(*) AS n_tables FROM scoped
        GROUP BY org_key, upper(category)""",
    "visible_solutions": f"""WITH {SUPPLIERS}
        SELECT org_key, org_key || '|' || unique_name AS solution_id, unique_name,
               CASE WHEN friendly_name = '' THEN unique_name ELSE friendly_name END
                 || CASE WHEN managed THEN ' (managed)' ELSE '' END AS label,
               CAST(row_number() OVER (PARTITION BY org_key
                 ORDER BY CASE WHEN upper(unique_name) = 'DEFAULT' THEN 0 ELSE 1 END, upper(friendly_name)) AS INTEGER)
                 AS position
        FROM suppliers, {values(fleet.SOLUTIONS, 'unique_name, friendly_name, managed, visible, parent')}
        WHERE visible AND parent IS NULL""",
    "chosen_solutions": f"""WITH {SUPPLIERS},
        listed AS (
          SELECT org_key, unique_name,
                 upper(coalesce(nullif([NULL, 'ZETA', 'patch1', 'gamma', ''][key % 5 + 1], ''), 'Default')) AS pick,
                 row_number() OVER (PARTITION BY org_key
                   ORDER BY CASE WHEN unique_name = 'Default' THEN 0 ELSE 1 END, upper(friendly_name)) AS place
          FROM suppliers, {values(fleet.SOLUTIONS, 'unique_name, friendly_name, managed, visible, parent')}
          WHERE visible AND parent IS NULL AND NOT (unique_name = 'Default' AND key % 2 = 1)),
        first AS (
          SELECT *, row_number() OVER (PARTITION BY org_key
                      ORDER BY CASE WHEN upper(unique_name) = pick THEN 0 ELSE 1 END, place) AS rank FROM listed)
        SELECT org_key, org_key || '|' || unique_name AS solution_id, unique_name FROM first
        WHERE rank = 1 AND unique_name != 'Default'""",
    "solution_membership": f"""WITH {SOLUTION_ROWS}
        SELECT org_key, 'entity' AS kind, object_id, CAST(min(coalesce(behavior, 0)) AS INTEGER) AS behavior
        FROM components WHERE key % 3 != 0 AND solution = 'zeta' AND type = 1 GROUP BY org_key, object_id
        UNION ALL
        SELECT DISTINCT org_key, 'attribute', object_id, CAST(NULL AS INTEGER)
        FROM components WHERE key % 3 != 0 AND solution = 'zeta' AND type = 2""",
    "find_tables": f"""WITH {ENTITIES}
        SELECT org_key, logical_name, display_name, category FROM in_solution
        WHERE upper(category) = 'X'
          AND (contains(upper(logical_name), 'SE') OR contains(upper(display_name), 'SE'))""",
    "find_checked_tables": f"""WITH {ENTITIES}
        SELECT s.org_key, logical_name, display_name, category FROM scoped s
        SEMI JOIN picks p ON s.org_key = p.org_key AND lower(s.logical_name) = p.pick
        WHERE contains(upper(logical_name), 'A') OR contains(upper(display_name), 'A')""",
    "effective_selection": f"""WITH {ENTITIES},
        effective AS (
          SELECT org_key, pick FROM picks
          UNION ALL
          SELECT org_key, unnest(['contact', 'x_site', 'gone']) FROM customers WHERE key % 5 = 0)
        SELECT s.org_key, logical_name AS "table" FROM in_solution s
        SEMI JOIN effective e ON s.org_key = e.org_key AND lower(s.logical_name) = e.pick""",
    "attributes_in_scope": f"""WITH {ATTRIBUTES}
        SELECT org_key, "table", logical_name, attr_type, is_primary_id, is_primary_name FROM scoped
        WHERE key % 3 = 0 OR is_primary_id OR is_primary_name OR key % 4 = 0
           OR logical_name IN ('x_legacyid', 'customerid', 'x_fee')""",
    "map_types": f"""WITH {TYPED}
        SELECT * REPLACE (CASE WHEN is_lookup THEN coalesce(array_to_string(targets, ','), '') END AS targets)
        FROM mapped""",
    "untyped_attributes": f"""WITH {ATTRIBUTES}
        SELECT org_key, "table", logical_name FROM scoped WHERE attr_type IS NULL""",
    "companions": f"""WITH {COLUMNS}
        SELECT org_key, "table", name, sql_type, is_lookup, is_polymorphic, is_type_companion, display_name, attr_type,
               additional_info, is_custom FROM columns""",
    "staging_layout": f"""WITH {COLUMNS},
        blocks AS (
          SELECT org_key, "table", name, sql_type, 1 AS block,
                 CASE WHEN is_lookup AND coalesce(len(targets), 0) = 0 THEN 'lookup (no targets reported)'
                      WHEN is_lookup THEN CASE WHEN is_polymorphic THEN 'polymorphic ' ELSE '' END || 'lookup: '
                        || array_to_string(targets[1:5], ', ')
                        || CASE WHEN len(targets) > 5 THEN ', ... (+' || (len(targets) - 5) || ' more)' ELSE '' END
                      WHEN is_type_companion THEN 'target table name for the polymorphic lookup above' END AS comment
          FROM columns
          UNION ALL
          SELECT org_key, 'x_case', name, sql_type, block, NULL
          FROM suppliers, (VALUES ('overriddencreatedon', 'DATETIME2(7)', 2), ('ownerid', 'NVARCHAR(100)', 3),
                                  ('owneridtype', 'NVARCHAR(100)', 4), ('statecode', 'INT', 5)) AS v(name, sql_type, block))
        SELECT org_key, "table", CAST(row_number() OVER (PARTITION BY org_key ORDER BY block, upper(name)) AS INTEGER)
                 AS ordinal, name, sql_type, comment FROM blocks""",
    "match_keys": f"""WITH {COLUMNS}
        SELECT org_key, "table", name, sql_type FROM columns
        WHERE ends_with(lower(name), 'legacyid') OR ends_with(lower(name), 'code')""",
    "key_map_layout": f"""WITH {COLUMNS}, {KEY_MAP.format(match="ends_with(lower(name), 'legacyid')")}
        SELECT org_key, "table", CAST(row_number() OVER (PARTITION BY org_key ORDER BY block, upper(name)) AS INTEGER)
                 AS ordinal, name, sql_type FROM ranked WHERE copy = 1""",
    "layout_conflicts": f"""WITH {COLUMNS}, {KEY_MAP.format(match='''(ends_with(lower(name), 'legacyid')
            OR ends_with(lower(name), 'title') OR ends_with(lower(name), 'orderid') OR ends_with(lower(name), 'type'))''')}
        SELECT org_key, "table", name, sql_type, CAST(block AS INTEGER) AS block FROM ranked WHERE copy > 1""",
    "dictionary_columns": f"""WITH {COLUMNS}
        SELECT org_key, "table", CAST(row_number() OVER (PARTITION BY org_key ORDER BY upper(name)) AS INTEGER)
                 AS position, name, display_name, attr_type,
               coalesce(array_to_string(targets, ', '), '') AS lookup_target, description,
               CASE WHEN is_custom THEN 'True' ELSE 'False' END AS custom_attribute,
               additional_info AS additional_data, sql_type FROM columns""",
    "dictionary_tables": f"""WITH {SUPPLIERS}
        SELECT org_key, CASE WHEN key % 2 = 0 THEN 'Case' ELSE 'x_case' END AS entity, 'Cases' AS plural_name,
               '' AS description, 'x_Case' AS schema_name, 'x_case' AS logical_name, '10042' AS object_type_code,
               'TRUE' AS is_custom_entity, 'UserOwned' AS ownership, '1.0' AS introduced_version,
               CAST(0 AS INTEGER) AS tier FROM suppliers""",
    "dictionary_index": f"""WITH {BATCHES},
        given_up AS (
          SELECT org_key, src, string_agg(dst, ', ' ORDER BY upper(dst)) AS names FROM dropped GROUP BY org_key, src)
        SELECT b.org_key,
               CAST(row_number() OVER (PARTITION BY b.org_key ORDER BY upper(shown.display), order_no) AS INTEGER)
                 AS position,
               shown.display AS display_name, b."table" AS logical_name,
               upper(b."table"[1]) || lower(b."table"[2:]) AS schema_name, tier, lpad(CAST(file_no AS VARCHAR), 2, '0') AS file,
               coalesce(g.names, '') AS dropped_dependencies
        FROM batches b
        JOIN {values([(n, d or n) for n, d, _ in fleet.CRM_TABLES], 'name, display').replace(' AS v(', ' AS shown(')}
          ON b."table" = shown.name
        LEFT JOIN given_up g ON b.org_key = g.org_key AND b."table" = g.src""",
    "dependency_edges": f"WITH {PLAN} SELECT org_key, src, dst FROM edges",
    "excluded_edges": f"""WITH {CUSTOMERS}
        SELECT DISTINCT org_key, source AS src, target AS dst
        FROM customers, {values(fleet.CRM_LOOKUPS, 'source, name, target, edge')}
        WHERE source != target AND coalesce(edge, -1) != key % {len(fleet.CRM_TIERS)}
          AND name NOT IN ('customerid', 'x_regionid', 'nothing')""",
    "load_tiers": f'WITH {PLAN} SELECT org_key, "table", tier FROM tiers',
    "dropped_edges": f"WITH {PLAN} SELECT org_key, src, dst FROM dropped",
    "cycle_warnings": f"""WITH {PLAN}
        SELECT org_key, src AS "table", 'Cycle: [' || src || '] placed before its lookup target(s) ['
               || string_agg(dst, ', ' ORDER BY upper(dst))
               || '] - resolve those lookups with a deferred update pass.' AS warning
        FROM dropped GROUP BY org_key, src""",
    "load_tiers_acyclic": f"""WITH RECURSIVE edges AS (SELECT * FROM {_chain_edges}),
        walk AS (
          SELECT name, CAST(0 AS INTEGER) AS depth FROM {_chain_tables}
          UNION ALL
          SELECT e.src, w.depth + 1 FROM walk w JOIN edges e ON e.dst = w.name),
        tiers AS (SELECT name, max(depth) AS tier FROM walk GROUP BY name)
        SELECT CAST(s_suppkey AS VARCHAR) AS org_key, name AS "table", tier FROM supplier, tiers""",
    "load_tiers_order_graphs": f"""WITH RECURSIVE {GRAPHS}, rows AS (SELECT org_key, unnest(placed) AS r FROM ended)
        SELECT org_key, r.t AS "table", CAST(r.tier AS INTEGER) AS tier FROM rows""",
    "dropped_edges_order_graphs": f"""WITH RECURSIVE {GRAPHS}, rows AS (SELECT org_key, unnest(given_up) AS r FROM ended)
        SELECT org_key, r.src AS src, r.dst AS dst FROM rows""",
    "load_batches": f"WITH {BATCHES} SELECT * EXCLUDE (order_no, reverse_no) FROM batches",
    "load_order": f'WITH {BATCHES} SELECT org_key, "table", order_no, reverse_no FROM batches',
    "diagram_edges": f"""WITH {PLAN}
        SELECT e.org_key, e.src, e.dst, CASE WHEN d.src IS NULL THEN 'kept' ELSE 'deferred' END AS status,
               a.tier AS src_tier, b.tier AS dst_tier
        FROM edges e LEFT JOIN dropped d ON e.org_key = d.org_key AND e.src = d.src AND e.dst = d.dst
        JOIN tiers a ON e.org_key = a.org_key AND e.src = a."table"
        JOIN tiers b ON e.org_key = b.org_key AND e.dst = b."table\"""",
    "plan_summary": f"""WITH {BATCHES},
        warned AS (SELECT org_key, CAST(count(DISTINCT src) AS INTEGER) AS n FROM dropped GROUP BY org_key)
        SELECT b.org_key, CAST(count(*) AS INTEGER) AS n_tables, CAST(max(tier) + 1 AS INTEGER) AS n_tiers,
               CAST(max(file_no) AS INTEGER) AS n_batches, CAST(2 * max(file_no) + 3 AS INTEGER) AS n_outputs,
               coalesce(max(w.n), 0) AS n_warnings
        FROM batches b LEFT JOIN warned w ON b.org_key = w.org_key GROUP BY b.org_key""",
    "staging_scripts": f"""WITH {COLUMNS},
        blocks AS (
          SELECT org_key, name, sql_type, 1 AS block,
                 CASE WHEN is_lookup AND coalesce(len(targets), 0) = 0 THEN '    -- lookup (no targets reported)'
                      WHEN is_lookup THEN CASE WHEN is_polymorphic THEN '    -- polymorphic ' ELSE '    -- ' END
                        || 'lookup: ' || array_to_string(targets[1:5], ', ')
                        || CASE WHEN len(targets) > 5 THEN ', ... (+' || (len(targets) - 5) || ' more)' ELSE '' END
                      WHEN is_type_companion THEN '    -- target table name for the polymorphic lookup above'
                      ELSE '' END AS comment
          FROM columns
          UNION ALL
          SELECT org_key, name, sql_type, block, ''
          FROM suppliers, (VALUES ('overriddencreatedon', 'DATETIME2(7)', 2), ('ownerid', 'NVARCHAR(100)', 3),
                                  ('owneridtype', 'NVARCHAR(100)', 4), ('statecode', 'INT', 5)) AS v(name, sql_type, block))
        SELECT org_key, '01_create_staging.sql' AS file_name, CAST(1 AS INTEGER) AS pos, 'x_case' AS "table",
               'DROP TABLE IF EXISTS [dbo].[stage_x_Case];' || chr(10) || 'CREATE TABLE [dbo].[stage_x_Case](' || chr(10)
               || string_agg('    [' || name || '] ' || sql_type || CASE WHEN block < 5 THEN ',' ELSE '' END || comment,
                             chr(10) ORDER BY block, upper(name)) || chr(10) || ');' AS statement
        FROM blocks GROUP BY org_key""",
    "key_map_scripts": f"""WITH {COLUMNS}, {KEY_MAP.format(match="ends_with(lower(name), 'legacyid')")}
        SELECT org_key, '01_create_guid.sql' AS file_name, CAST(1 AS INTEGER) AS pos, 'x_case' AS "table",
               'IF OBJECT_ID(N''[dbo].[ids_x_Case]'', N''U'') IS NULL' || chr(10) || 'BEGIN' || chr(10)
               || 'CREATE TABLE [dbo].[ids_x_Case](' || chr(10)
               || string_agg('    [' || name || '] ' || sql_type || ' NULL', ',' || chr(10) ORDER BY block, upper(name))
               || chr(10) || ');' || chr(10) || 'END' || chr(10)
               || 'IF NOT EXISTS (SELECT 1 FROM sys.indexes WHERE [name] = N''IX_ids_x_Case_x_legacyid'' AND [object_id] = '
               || 'OBJECT_ID(N''[dbo].[ids_x_Case]''))' || chr(10)
               || '    CREATE NONCLUSTERED INDEX [IX_ids_x_Case_x_legacyid] ON [dbo].[ids_x_Case]([x_legacyid]);' AS statement
        FROM ranked WHERE copy = 1 GROUP BY org_key""",
    "truncate_script": _reset("TRUNCATE TABLE", "truncate.sql", "dbo"),
    "teardown_script": _reset("DROP TABLE IF EXISTS", "teardown.sql", "mig"),
    "diagram_script": f"""WITH {BATCHES},
        shown AS (
          SELECT b.*, s.display FROM batches b
          JOIN {values([(n, d or n) for n, d, _ in fleet.CRM_TABLES], 'name, display').replace(' AS v(', ' AS s(')}
            ON b."table" = s.name),
        lines AS (
          SELECT DISTINCT org_key, 0 AS block, 0 AS tier, 0 AS step, 0 AS order_no, '' AS name, 'flowchart TD' AS line
          FROM shown
          UNION ALL
          SELECT DISTINCT org_key, 1, tier, 1, 0, '', '    subgraph tier' || tier || '["Tier ' || tier || '"]' FROM shown
          UNION ALL
          SELECT org_key, 1, tier, 2, order_no, '',
                 '        ' || "table" || '["' || display || '<br/><small>' || "table" || '</small>"]' FROM shown
          UNION ALL
          SELECT DISTINCT org_key, 1, tier, 3, 0, '', '    end' FROM shown
          UNION ALL
          SELECT e.org_key, 2, 0, 0, s.order_no, upper(e.dst),
                 '    ' || e.src || CASE WHEN d.src IS NULL THEN ' --> ' ELSE ' -.-> ' END || e.dst
          FROM edges e JOIN shown s ON e.org_key = s.org_key AND e.src = s."table"
          LEFT JOIN dropped d ON e.org_key = d.org_key AND e.src = d.src AND e.dst = d.dst)
        SELECT org_key, 'diagram.mmd' AS file_name, CAST(row_number() OVER (
                 PARTITION BY org_key ORDER BY block, tier, step, order_no, name) AS INTEGER) AS line_no, line FROM lines""",
    "stage_orders": """
        SELECT CAST(o_custkey AS VARCHAR) AS "O_CustKey", o_orderdate, CAST(o_orderkey AS VARCHAR) AS o_orderkey,
               o_orderpriority, o_orderstatus, CAST(NULL AS VARCHAR) AS o_remark,
               CAST(CAST(o_totalprice AS DECIMAL(38, 2)) AS VARCHAR) AS o_totalprice,
               CAST(NULL AS TIMESTAMP) AS overriddencreatedon, CAST(NULL AS VARCHAR) AS ownerid,
               CAST(NULL AS VARCHAR) AS owneridtype, CAST(NULL AS INTEGER) AS statecode FROM orders""",
    "stage_rejects": """
        SELECT 'documents' AS "table", doc_id AS row_key, 'text' AS "column", 'length' AS reason, md5(text) AS value_md5
        FROM documents WHERE length(text) > 4000
        UNION ALL
        SELECT 'events', event_id, 'props', 'type', md5(props) FROM events
        WHERE props IS NOT NULL AND TRY_CAST(props AS INTEGER) IS NULL""",
    "stage_rejects_lossy": """
        SELECT 'orders' AS "table", o_orderkey AS row_key, 'o_totalprice' AS "column",
               CASE WHEN abs(o_totalprice) >= 2147483648 THEN 'type' ELSE 'precision' END AS reason
        FROM orders WHERE o_totalprice != trunc(o_totalprice) OR abs(o_totalprice) >= 2147483648
        UNION ALL
        SELECT 'orders', o_orderkey, 'o_orderdate', 'precision' FROM orders WHERE o_orderdate != date_trunc('day', o_orderdate)
        UNION ALL
        SELECT 'events', event_id, 'ts', 'precision' FROM events WHERE ts != date_trunc('day', ts)
        UNION ALL
        SELECT 'events', event_id, 'user_id', 'type' FROM events WHERE user_id NOT BETWEEN -32768 AND 32767
        UNION ALL
        SELECT 'documents', doc_id, 'text', 'type' FROM documents
        WHERE text IS NOT NULL AND TRY_CAST(text AS DECIMAL(38, 2)) IS NULL""",
    "stage_clean": """
        SELECT doc_id, lang, text, CAST(NULL AS INTEGER) AS statecode FROM documents
        WHERE coalesce(length(text), 0) <= 4000 AND coalesce(length(lang), 0) <= 2""",
    "staging_modes": """
        SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment, CAST(1 AS BIGINT) AS copies,
               'drop_recreate' AS mode FROM customer
        UNION ALL
        SELECT CAST(c_custkey AS VARCHAR), c_mktsegment, CAST(2 AS BIGINT), 'create_if_missing' FROM customer""",
    "key_map": f"""SELECT {_md5('customer', 'c_custkey')} AS target_id, CAST(c_custkey AS VARCHAR) AS legacy_key,
               c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation FROM customer""",
    "key_map_shared_keys": f"""
        SELECT {_md5('part', 'p_partkey')} AS target_id, p_name AS legacy_key, p_brand AS name FROM part
        QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY {_md5('part', 'p_partkey')}) = 1""",
    "key_map_conflicts": f"""
        SELECT {_md5('part', 'p_partkey')} AS target_id, p_name AS legacy_key,
               min({_md5('part', 'p_partkey')}) OVER (PARTITION BY p_name) AS kept_id, 'duplicate' AS reason FROM part
        QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY {_md5('part', 'p_partkey')}) > 1""",
    "key_map_merge": f"""
        SELECT CASE WHEN c_custkey % 2 = 0 THEN {_md5('earlier', 'c_custkey')} ELSE {_md5('customer', 'c_custkey')} END
                 AS target_id, CAST(c_custkey AS VARCHAR) AS legacy_key FROM customer""",
    "key_map_versions": f"""
        SELECT CASE WHEN c_custkey % 2 = 0 THEN {_md5('earlier', 'c_custkey')} ELSE {_md5('customer', 'c_custkey')} END
                 AS target_id, CAST(c_custkey AS VARCHAR) AS legacy_key, CASE WHEN c_custkey % 2 = 1 THEN c_name END AS name
        FROM customer""",
    "load_twice": f"""
        SELECT 'loaded' AS kind, CAST(c_custkey AS VARCHAR) AS legacy_key, {_md5('customer', 'c_custkey')} AS target_id
        FROM customer WHERE c_custkey % 2 = 1
        UNION ALL
        SELECT 'map', CAST(c_custkey AS VARCHAR),
               CASE WHEN c_custkey % 2 = 0 THEN {_md5('earlier', 'c_custkey')} ELSE {_md5('customer', 'c_custkey')} END
        FROM customer""",
    "load_conflicts": f"""
        SELECT {_md5('part', 'p_partkey')} AS target_id, p_name AS legacy_key,
               min({_md5('part', 'p_partkey')}) OVER (PARTITION BY p_name) AS kept_id, 'duplicate' AS reason FROM part
        QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY {_md5('part', 'p_partkey')}) > 1""",
    "unresolved_report_lineitems": """
        WITH keys AS (
          SELECT unnest([{'lookup': 'l_orderkey', 'k': l_orderkey}, {'lookup': 'l_partkey', 'k': l_partkey},
                         {'lookup': 'l_suppkey', 'k': l_suppkey}], recursive := true) FROM lineitem),
        known AS (
          SELECT 'l_orderkey' AS lookup, o_orderkey AS k FROM orders WHERE o_orderkey % 10 != 0
          UNION ALL SELECT 'l_partkey', p_partkey FROM part WHERE p_partkey % 10 != 0
          UNION ALL SELECT 'l_suppkey', s_suppkey FROM supplier WHERE s_suppkey % 10 != 0),
        judged AS (
          SELECT lookup, CAST(k AS VARCHAR) AS k, EXISTS (SELECT 1 FROM known WHERE known.lookup = keys.lookup AND known.k = keys.k) AS hit
          FROM keys),
        missing AS (SELECT DISTINCT lookup, k FROM judged WHERE NOT hit),
        first AS (SELECT lookup, k FROM missing QUALIFY row_number() OVER (PARTITION BY lookup ORDER BY k) <= 5)
        SELECT 'lineitem' AS "table", lookup, CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_empty,
               count(*) FILTER (WHERE hit) AS n_resolved, count(*) FILTER (WHERE NOT hit) AS n_unresolved,
               (SELECT count(*) FROM missing m WHERE m.lookup = j.lookup) AS n_missing_keys,
               coalesce((SELECT string_agg(k, ', ' ORDER BY k) FROM first f WHERE f.lookup = j.lookup), '') AS missing_sample
        FROM judged j GROUP BY lookup""",
    "key_map_rebuild": f"""SELECT {_md5('customer', 'c_custkey')} AS target_id,
               CAST(c_custkey AS VARCHAR) AS legacy_key FROM customer""",
    "resolve_orders": RESOLVED_ORDERS,
    "resolve_lineitems": f"""
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
               {_md5('orders', 'o_orderkey')} AS l_orderkey_id,
               CASE WHEN o_orderkey IS NULL THEN 'unresolved' ELSE 'resolved' END AS l_orderkey_status,
               {_md5('part', 'p_partkey')} AS l_partkey_id,
               CASE WHEN p_partkey IS NULL THEN 'unresolved' ELSE 'resolved' END AS l_partkey_status,
               {_md5('supplier', 's_suppkey')} AS l_suppkey_id,
               CASE WHEN s_suppkey IS NULL THEN 'unresolved' ELSE 'resolved' END AS l_suppkey_status
        FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
        LEFT JOIN supplier ON l_suppkey = s_suppkey""",
    "resolve_event_owner": f"""
        SELECT event_id, CAST(user_id AS VARCHAR) AS owner,
               CASE WHEN event_type IN ('purchase', 'signup') THEN 'Customer' ELSE 'supplier' END AS ownertype,
               CASE WHEN event_type IN ('purchase', 'signup') THEN {_md5('customer', 'c_custkey')}
                    ELSE {_md5('supplier', 's_suppkey')} END AS owner_id,
               CASE WHEN user_id IS NULL THEN 'empty'
                    WHEN CASE WHEN event_type IN ('purchase', 'signup') THEN c_custkey ELSE s_suppkey END IS NULL
                    THEN 'unresolved' ELSE 'resolved' END AS owner_status
        FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN supplier ON user_id = s_suppkey""",
    "unresolved_report": f"""WITH resolved AS ({RESOLVED_ORDERS}),
        missing AS (SELECT DISTINCT o_custkey FROM resolved WHERE o_custkey_status = 'unresolved'),
        first AS (SELECT o_custkey FROM missing ORDER BY o_custkey LIMIT 5)
        SELECT 'orders' AS "table", 'o_custkey' AS lookup, CAST(count(*) AS BIGINT) AS n_rows,
               CAST(0 AS BIGINT) AS n_empty, count(*) FILTER (WHERE o_custkey_status = 'resolved') AS n_resolved,
               count(*) FILTER (WHERE o_custkey_status = 'unresolved') AS n_unresolved,
               (SELECT count(*) FROM missing) AS n_missing_keys,
               (SELECT string_agg(o_custkey, ', ' ORDER BY o_custkey) FROM first) AS missing_sample
        FROM resolved""",
    "polymorphic_load": f"""
        SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS owner,
               CASE WHEN event_type IN ('purchase', 'signup') THEN 'Customer' ELSE 'supplier' END AS ownertype,
               CASE WHEN event_type IN ('purchase', 'signup') THEN {_md5('customer', 'c_custkey')}
                    ELSE {_md5('supplier', 's_suppkey')} END AS owner_id,
               CASE WHEN user_id IS NULL THEN 'empty'
                    WHEN CASE WHEN event_type IN ('purchase', 'signup') THEN c_custkey ELSE s_suppkey END IS NULL
                    THEN 'unresolved' ELSE 'resolved' END AS owner_status,
               {_md5('events', 'event_id')} AS target_id
        FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN supplier ON user_id = s_suppkey""",
    "tiered_load": _loaded_lookups(),
    "deferred_update": f"""
        SELECT 'orders' AS "table", CAST(o_orderkey AS VARCHAR) AS row_key, {_md5('customer', 'c_custkey')} AS resolved_id,
               CASE WHEN c_custkey IS NULL THEN 'unresolved' ELSE 'resolved' END AS status
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey
        UNION ALL
        SELECT 'customer', CAST(c_custkey AS VARCHAR), {_md5('orders', 'first_order')},
               CASE WHEN first_order IS NULL THEN 'empty' ELSE 'resolved' END
        FROM customer LEFT JOIN (
          SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY o_custkey)
          ON o_custkey = c_custkey""",
    "deferred_update_keeps_ids": f"""
        SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
               CASE WHEN o_custkey % 2 = 0 THEN {_md5('earlier', 'o_custkey')}
                    WHEN o_custkey % 10 != 0 THEN {_md5('customer', 'c_custkey')} END AS o_custkey_id,
               CASE WHEN o_custkey % 2 = 0 OR (o_custkey % 10 != 0 AND c_custkey IS NOT NULL)
                    THEN 'resolved' ELSE 'unresolved' END AS o_custkey_status
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "deferred_over_runs": f"""
        SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
               {_md5('customer', 'c_custkey')} AS o_custkey_id,
               CASE WHEN o_custkey IS NULL THEN 'empty' WHEN c_custkey IS NULL THEN 'unresolved' ELSE 'resolved' END
                 AS o_custkey_status
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "wave_load_orders": f"""
        WITH numbered AS (
          SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) // 6 AS chain FROM orders),
        chained AS (
          SELECT o_orderkey, o_custkey, chain, lag(o_orderkey) OVER w AS before, last_value(o_orderkey) OVER (
                   PARTITION BY o_custkey, chain ORDER BY o_orderdate, o_orderkey
                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last
          FROM numbered WINDOW w AS (PARTITION BY o_custkey, chain ORDER BY o_orderdate, o_orderkey)),
        linked AS (
          SELECT o_orderkey, o_custkey, coalesce(before, CASE WHEN o_custkey % 10 = 0 THEN last END) AS parent,
                 min(CAST(o_orderkey AS VARCHAR)) OVER (PARTITION BY o_custkey, chain) AS opened
          FROM chained)
        SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(parent AS VARCHAR) AS parent,
               CASE WHEN o_custkey % 10 <> 0 OR CAST(o_orderkey AS VARCHAR) <> opened
                    THEN {_md5('orders', 'parent')} END AS first_id,
               {_md5('orders', 'parent')} AS parent_id,
               CASE WHEN parent IS NULL THEN 'empty' ELSE 'resolved' END AS parent_status,
               {_md5('orders', 'o_orderkey')} AS target_id
        FROM linked""",
    "load_resumed": """
        SELECT CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS legacy_key, c_name AS other,
               count(*) AS n_loads, count(*) AS n_ids
        FROM customer GROUP BY 1, 2
        UNION ALL
        SELECT CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey AS VARCHAR) END, CAST(o_custkey AS VARCHAR),
               count(*), count(*)
        FROM orders GROUP BY 1, 2""",
    "key_map_incremental": f"""
        SELECT {_md5('customer', 'c_custkey')} AS target_id, CAST(c_custkey AS VARCHAR) AS legacy_key, true AS as_expected
        FROM customer""",
    "catalog_load": _catalog_load(),
    "reset_keeps_key_maps": _counts_after_reset(),
    "clustered_resolve": RESOLVED_ORDERS,
    "row_waves_orders": """
        SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS wave
        FROM orders""",
    "row_waves_turns": "SELECT conv_id || '/' || turn AS id, CAST(turn AS BIGINT) AS wave FROM conversations",
    "row_waves_cycles": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 5 - o_orderkey % 5 END AS wave
        FROM orders""",
    "row_waves_dropped": "SELECT o_orderkey, o_orderkey + 1 AS parent FROM orders WHERE o_orderkey % 5 = 0",
    "staged_profile": _profile(),
    "profile_of_loads": f"""SELECT name, n_rows, n_null, max_length, true AS "close" FROM ({_profile()})""",
    "replan_changed": """
        SELECT CAST(s_suppkey AS VARCHAR) AS org_key,
               CASE WHEN s_suppkey % 10 = 0 THEN 'NVARCHAR(300)' ELSE 'NVARCHAR(200)' END AS sql_type,
               CASE WHEN s_suppkey % 10 = 0 THEN 2 ELSE 1 END AS planned
        FROM supplier WHERE s_suppkey % 11 <> 0""",
}
