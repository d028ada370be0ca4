"""The same answers in ANSI SQL, for DuckDB on the same tables."""

from __future__ import annotations


def number(column: str) -> str:
    """Double as text: no trailing ``.0``."""
    return rf"regexp_replace(CAST({column} AS VARCHAR), '\.0$', '')"


def day(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d')"


def string(column: str) -> str:
    """JSON string or null."""
    return f"coalesce(CAST(to_json({column}) AS VARCHAR), 'null')"


def csv(column: str) -> str:
    """A comma, quote or line break (code points 10 and 13) asks for quotes."""
    special = " OR ".join(f"contains({column}, {c})" for c in ("','", "'\"'", "chr(10)", "chr(13)"))
    doubled = f"""'"' || replace({column}, '"', '""') || '"'"""
    return f"coalesce(CASE WHEN {special} THEN {doubled} ELSE {column} END, '')"


def xml(name: str, column: str) -> str:
    """The test tables hold no character that XML cannot."""
    safe = f"replace(replace(replace({column}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return (
        f"CASE WHEN {column} IS NULL THEN '<{name} nil=\"true\" />' "
        f"WHEN {column} = '' THEN '<{name} />' ELSE '<{name}>' || {safe} || '</{name}>' END"
    )


ORDER_COLUMNS = """o_orderkey AS "OrderKey", o_orderstatus AS "Status", o_totalprice AS "Total",
  o_orderdate AS "OrderDate", o_orderpriority AS "Priority" """
GAPS = "(SELECT * REPLACE (nullif(o_orderstatus, 'P') AS o_orderstatus) FROM orders)"


def orders(where: str, source: str = "orders") -> str:
    return f"SELECT {ORDER_COLUMNS} FROM {source} WHERE {where}"


def nested_orders(where: str = "TRUE") -> str:
    return f"""
WITH o AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place
  FROM orders WHERE {where}
)
SELECT c_custkey AS "CustKey", place AS "Position", o_orderkey AS "OrderKey",
  o_orderstatus AS "Status", o_orderdate AS "OrderDate"
FROM customer LEFT JOIN o ON o_custkey = c_custkey"""


CUSTOMER_MEMBERS = (
    "'\"CustKey\":' || c_custkey || ',\"Name\":' || " + string("c_name")
    + " || ',\"Balance\":' || " + number("c_acctbal")
    + " || ',\"Segment\":' || " + string("c_mktsegment")
)
ORDER_MEMBERS = (
    "'\"OrderKey\":' || o_orderkey || ',\"Status\":' || " + string("o_orderstatus")
    + " || ',\"Total\":' || " + number("o_totalprice")
    + " || ',\"OrderDate\":\"' || " + day("o_orderdate")
    + " || '\",\"Priority\":' || " + string("o_orderpriority")
)
LINE_MEMBERS = (
    "'\"LineNumber\":' || l_linenumber || ',\"PartKey\":' || l_partkey || ',\"Quantity\":' || "
    + number("l_quantity") + " || ',\"Shipped\":\"' || " + day("l_shipdate") + " || '\"'"
)
DOCUMENT_MEMBERS = (
    "'\"DocId\":' || d.doc_id || ',\"Lang\":' || " + string("lang")
    + " || ',\"Text\":' || " + string("text")
)
LABEL_MEMBERS = "'{\"Quality\":' || quality || ',\"Toxic\":' || toxic || '}'"

LONG = "(event_id % 1000) || '1234567.' || lpad(CAST(user_id AS VARCHAR), 18, '0')"
GEO_NUMBERS = """
WITH r AS (SELECT r_regionkey, row_number() OVER (ORDER BY r_regionkey) AS rn FROM region),
n AS (
  SELECT n_nationkey, r.rn AS up, row_number() OVER (ORDER BY r.rn, n_nationkey) AS rn
  FROM nation JOIN r ON n_regionkey = r_regionkey
),
c AS (
  SELECT c_custkey, c_name, n.rn AS up, row_number() OVER (ORDER BY n.rn, c_custkey) AS rn
  FROM customer JOIN n ON c_nationkey = n_nationkey
),
o AS (
  SELECT o_orderkey, c.rn AS up, row_number() OVER (ORDER BY c.rn, o_orderkey) AS rn
  FROM orders JOIN c ON o_custkey = c_custkey
)
"""

# Places inside a document: 0 opens it, 1 holds rows, 2 closes it; inside a row a null opens it,
# list i has 3i+1 (open), 3i+2 (rows) and 3i+3 (close), and 2147483647 closes the row.
CLOSE = "2147483647"



def pieces(parts: list[tuple[dict[int, str], str, str]], types: list[str]) -> str:
    """Union of pieces: (place columns, text, FROM and WHERE)."""
    selects = []
    for places, text, source in parts:
        columns = ", ".join(
            f"CAST({places.get(i, 'NULL')} AS {kind}) AS place_{i}" for i, kind in enumerate(types)
        )
        selects.append(f"SELECT {columns}, {text} AS text {source}")
    return "\nUNION ALL\n".join(selects)


def comma(key: str, table: str, tie: str = "TRUE") -> str:
    """Nothing before the first row of a list, a comma before the others."""
    smallest = f"(SELECT min(x.{key}) FROM {table} x WHERE {tie})"
    return f"CASE WHEN {key} = {smallest} THEN '' ELSE ',' END"


NATIONS = "nation JOIN region ON n_regionkey = r_regionkey"
CUSTOMERS = f"customer JOIN nation ON c_nationkey = n_nationkey {NATIONS[7:]}"
SUPPLIERS = f"supplier JOIN nation ON s_nationkey = n_nationkey {NATIONS[7:]}"
ORDERS = f"orders JOIN customer ON o_custkey = c_custkey {CUSTOMERS[9:]}"
# Places: step, region, step, nation, step, customer or supplier, step, order.
REGION = {0: "1", 1: "r_regionkey"}
NATION = REGION | {2: "2", 3: "n_nationkey"}
CUSTOMER = NATION | {4: "2", 5: "c_custkey"}
ORDER = CUSTOMER | {6: "2", 7: "o_orderkey"}
SUPPLIER = NATION | {4: "5", 5: "s_suppkey"}
HAS_NATION = "WHERE EXISTS (SELECT 1 FROM nation x WHERE x.n_regionkey = r_regionkey)"
HAS_CUSTOMER = "WHERE EXISTS (SELECT 1 FROM customer x WHERE x.c_nationkey = n_nationkey)"
HAS_SUPPLIER = "WHERE EXISTS (SELECT 1 FROM supplier x WHERE x.s_nationkey = n_nationkey)"
HAS_ORDER = "WHERE EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = c_custkey)"


def geography_json() -> str:
    first_nation = comma("n_nationkey", "nation", "x.n_regionkey = nation.n_regionkey")
    first_customer = comma("c_custkey", "customer", "x.c_nationkey = customer.c_nationkey")
    first_supplier = comma("s_suppkey", "supplier", "x.s_nationkey = supplier.s_nationkey")
    first_order = comma("o_orderkey", "orders", "x.o_custkey = orders.o_custkey")
    supplier = f"""'{{"SuppKey":' || s_suppkey || ',"Name":' || {string("s_name")} || '}}'"""
    return pieces(
        [
            ({0: "0"}, "'['", ""),
            ({0: "2"}, "']'", ""),
            (
                REGION,
                f"""{comma("r_regionkey", "region")} || '{{"Region":' || {string("r_name")}""",
                "FROM region",
            ),
            (REGION | {2: "1"}, """',"Nation":['""", f"FROM region {HAS_NATION}"),
            (REGION | {2: "3"}, "']'", f"FROM region {HAS_NATION}"),
            (REGION | {2: CLOSE}, "'}'", "FROM region"),
            (
                NATION,
                f"""{first_nation} || '{{"Nation":' || {string("n_name")}""",
                f"FROM {NATIONS}",
            ),
            (NATION | {4: "1"}, """',"Customer":['""", f"FROM {NATIONS} {HAS_CUSTOMER}"),
            (NATION | {4: "3"}, "']'", f"FROM {NATIONS} {HAS_CUSTOMER}"),
            (NATION | {4: "4"}, """',"Supplier":['""", f"FROM {NATIONS} {HAS_SUPPLIER}"),
            (NATION | {4: "6"}, "']'", f"FROM {NATIONS} {HAS_SUPPLIER}"),
            (NATION | {4: CLOSE}, "'}'", f"FROM {NATIONS}"),
            (CUSTOMER, f"{first_customer} || '{{' || {CUSTOMER_MEMBERS}", f"FROM {CUSTOMERS}"),
            (CUSTOMER | {6: "1"}, """',"Order":['""", f"FROM {CUSTOMERS} {HAS_ORDER}"),
            (CUSTOMER | {6: "3"}, "']'", f"FROM {CUSTOMERS} {HAS_ORDER}"),
            (CUSTOMER | {6: CLOSE}, "'}'", f"FROM {CUSTOMERS}"),
            (ORDER, f"{first_order} || '{{' || {ORDER_MEMBERS} || '}}'", f"FROM {ORDERS}"),
            (SUPPLIER, f"{first_supplier} || {supplier}", f"FROM {SUPPLIERS}"),
        ],
        ["BIGINT"] * 8,
    )


def element(name: str, value: str) -> str:
    """An element around text that needs no escaping."""
    return f"'<{name}>' || {value} || '</{name}>'"


CUSTOMER_ELEMENTS = " || ".join(
    [
        element("CustKey", "c_custkey"),
        xml("Name", "c_name"),
        element("Balance", number("c_acctbal")),
        xml("Segment", "c_mktsegment"),
    ]
)
ORDER_ELEMENTS = " || ".join(
    [
        element("OrderKey", "o_orderkey"),
        xml("Status", "o_orderstatus"),
        element("Total", number("o_totalprice")),
        element("OrderDate", day("o_orderdate")),
        xml("Priority", "o_orderpriority"),
    ]
)


def geography_xml() -> str:
    heading = """'<?xml version="1.0" encoding="utf-8"?><geography>'"""
    supplier = " || ".join([element("SuppKey", "s_suppkey"), xml("Name", "s_name")])
    return pieces(
        [
            ({0: "0"}, heading, ""),
            ({0: "2"}, "'</geography>'", ""),
            (REGION, f"'<Region>' || {xml('Region', 'r_name')}", "FROM region"),
            (REGION | {2: CLOSE}, "'</Region>'", "FROM region"),
            (NATION, f"'<Nation>' || {xml('Nation', 'n_name')}", f"FROM {NATIONS}"),
            (NATION | {4: CLOSE}, "'</Nation>'", f"FROM {NATIONS}"),
            (CUSTOMER, f"'<Customer>' || {CUSTOMER_ELEMENTS}", f"FROM {CUSTOMERS}"),
            (CUSTOMER | {6: CLOSE}, "'</Customer>'", f"FROM {CUSTOMERS}"),
            (ORDER, f"'<Order>' || {ORDER_ELEMENTS} || '</Order>'", f"FROM {ORDERS}"),
            (SUPPLIER, f"'<Supplier>' || {supplier} || '</Supplier>'", f"FROM {SUPPLIERS}"),
        ],
        ["BIGINT"] * 8,
    )


LINE_KEY = (
    "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
)


def customer_json() -> str:
    """Places: step, customer, step, order, step, the columns of a line's key."""
    customer = {0: "1", 1: "c_custkey"}
    order = customer | {2: "2", 3: "o_orderkey"}
    line = order | {4: "2"} | {5 + i: c for i, c in enumerate(LINE_KEY.split(", "))}
    of_customer = "FROM orders JOIN customer ON o_custkey = c_custkey"
    has_line = "WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"
    numbered = f"(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_KEY}) AS rn FROM lineitem)"
    return pieces(
        [
            ({0: "0"}, "'['", ""),
            ({0: "2"}, "']'", ""),
            (
                customer,
                f"{comma('c_custkey', 'customer')} || '{{' || {CUSTOMER_MEMBERS}",
                "FROM customer",
            ),
            (customer | {2: "1"}, """',"Order":['""", f"FROM customer {HAS_ORDER}"),
            (customer | {2: "3"}, "']'", f"FROM customer {HAS_ORDER}"),
            (customer | {2: CLOSE}, "'}'", "FROM customer"),
            (
                order,
                f"{comma('o_orderkey', 'orders', 'x.o_custkey = orders.o_custkey')} "
                f"|| '{{' || {ORDER_MEMBERS}",
                of_customer,
            ),
            (order | {4: "1"}, """',"Line":['""", f"{of_customer} {has_line}"),
            (order | {4: "3"}, "']'", f"{of_customer} {has_line}"),
            (order | {4: CLOSE}, "'}'", of_customer),
            (
                line,
                f"CASE WHEN rn = 1 THEN '' ELSE ',' END || '{{' || {LINE_MEMBERS} || '}}'",
                f"{of_customer} JOIN {numbered} ON l_orderkey = o_orderkey",
            ),
        ],
        ["BIGINT"] * 9 + ["DOUBLE", "DOUBLE", "TIMESTAMP"],
    )


DOCUMENT_NUMBERS = "SELECT *, row_number() OVER (ORDER BY doc_id) AS rn FROM documents"


ORACLES = {
    "flat_export": f"""
SELECT row_number() OVER (ORDER BY o_orderkey) AS "RowNumber", {ORDER_COLUMNS} FROM orders""",
    "composite_key_export": """
SELECT row_number() OVER (ORDER BY conv_id, turn) AS "RowNumber", conv_id AS "Conversation",
  turn AS "Turn", role AS "Role", text AS "Said" FROM conversations""",
    "filter_equals": orders("o_orderstatus = 'F'"),
    "filter_in": orders("o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "filter_gte": orders("o_totalprice >= 250000.50"),
    "filter_lte": orders("o_orderdate <= TIMESTAMP '1997-06-30'"),
    "filter_between": orders(
        "o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'"
    ),
    "filter_is_null": orders("o_orderstatus IS NULL", GAPS),
    "filter_is_not_null": orders("o_orderstatus IS NOT NULL", GAPS),
    "filter_conjunction": orders(
        "o_orderstatus = 'O' AND o_totalprice >= 100000 AND o_orderdate <= TIMESTAMP '1998-12-31'"
    ),
    "child_of_filtered_parent": orders(
        "o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"
    ),
    "child_filter_keeps_parents": nested_orders("o_orderstatus = 'F'"),
    "null_and_orphan_keys_drop": orders(
        "o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' "
        "AND o_custkey IN (SELECT c_custkey FROM customer)"
    ),
    "level_transform": """
SELECT upper(c_name) AS "Name", o_orderkey AS "OrderKey", lower(o_orderpriority) AS "Priority"
FROM customer JOIN orders ON o_custkey = c_custkey""",
    "number_root": """
SELECT row_number() OVER (ORDER BY c_custkey) AS "RowNumber", CAST(0 AS BIGINT) AS "ParentRowNumber",
  c_custkey AS "CustKey", c_name AS "Name" FROM customer""",
    "number_child": """
WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer)
SELECT row_number() OVER (ORDER BY rn, o_orderkey) AS "RowNumber", rn AS "ParentRowNumber",
  o_orderkey AS "OrderKey", o_orderstatus AS "Status"
FROM orders JOIN c ON o_custkey = c_custkey""",
    "number_grandchild": f"""{GEO_NUMBERS}
SELECT rn AS "RowNumber", up AS "ParentRowNumber", c_custkey AS "CustKey", c_name AS "Name" FROM c""",
    "number_fourth_level": f"""{GEO_NUMBERS}
SELECT rn AS "RowNumber", up AS "ParentRowNumber", o_orderkey AS "OrderKey" FROM o""",
    "nest_two_levels": nested_orders(),
    "nest_three_levels": f"""
WITH l AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_KEY}) - 1 AS place FROM lineitem
)
SELECT c_custkey AS "CustKey", o_orderkey AS "OrderKey", place AS "Position",
  l_linenumber AS "LineNumber", l_partkey AS "PartKey", l_quantity AS "Quantity"
FROM customer JOIN orders ON o_custkey = c_custkey LEFT JOIN l ON l_orderkey = o_orderkey""",
    "nest_four_levels": geography_json(),
    "nest_siblings": """
WITH o AS (
  SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS listed
  FROM orders GROUP BY o_custkey
), e AS (
  SELECT user_id, string_agg(event_id || ':' || event_type, ',' ORDER BY event_id) AS listed
  FROM events GROUP BY user_id
)
SELECT c_custkey AS "CustKey", coalesce(o.listed, '') AS "Orders", coalesce(e.listed, '') AS "Events"
FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN e ON user_id = c_custkey""",
    "rebuild_from_numbers": nested_orders(),
    "bundle_round_trip": nested_orders(),
    "row_counts": """
SELECT 'Region' AS entity, count(*) AS rows FROM region
UNION ALL SELECT 'Nation', count(*) FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'Customer', count(*) FROM customer WHERE c_nationkey IN (
  SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)
UNION ALL SELECT 'Supplier', count(*) FROM supplier WHERE s_nationkey IN (
  SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)
UNION ALL SELECT 'Order', count(*) FROM orders WHERE o_custkey IN (
  SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)""",
    "key_violations": """
SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
    "code_list_scan": """
SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS code
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'""",
    "lookup_render": """
SELECT c_custkey AS "CustKey", coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS "Nation"
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "lookup_miss_passes_raw": """
SELECT c_custkey AS "CustKey", coalesce(code, CAST(c_nationkey AS VARCHAR)) AS "Nation"
FROM customer LEFT JOIN (
  SELECT n_nationkey, n_name AS code FROM nation JOIN region ON n_regionkey = r_regionkey
  WHERE r_name = 'EUROPE') ON c_nationkey = n_nationkey""",
    "lookup_null_stays_null": """
SELECT c_custkey AS "CustKey", CASE WHEN c_mktsegment <> 'BUILDING' THEN n_name END AS "Nation"
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "lookup_in_json": """
SELECT '{"CustKey":' || c_custkey || ',"Nation":'
  || coalesce('"' || code || '"', CAST(c_nationkey AS VARCHAR)) || '}' AS json
FROM customer LEFT JOIN (
  SELECT n_nationkey, n_name AS code FROM nation JOIN region ON n_regionkey = r_regionkey
  WHERE r_name = 'EUROPE') ON c_nationkey = n_nationkey""",
    "filter_by_readable_value": """
SELECT c_custkey AS "CustKey", n_name AS "Nation" FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE lower(n_name) IN ('nation_3', 'nation_20')""",
    "custom_request_lookup": """
SELECT c_custkey AS "CustKey", 'No. ' || c_nationkey AS "Nation" FROM customer WHERE c_nationkey IN (3, 20)""",
    "filter_in_large": orders("o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 40)"),
    "parse_long_decimals": f"""
SELECT event_id, CAST(CAST({LONG} AS DECIMAL(38, 18)) AS VARCHAR) AS long, TRUE AS long_ok,
  '-1.' || lpad(CAST(user_id AS VARCHAR), 18, '0') AS small, TRUE AS small_ok,
  CAST(NULL AS VARCHAR) AS over, FALSE AS over_ok
FROM events""",
    "flat_csv_file": f"""
SELECT 'DocId,Lang,Source,Text' AS text UNION ALL
SELECT doc_id || ',' || {csv("lang")} || ',' || {csv("source")} || ',' || {csv("text")} FROM documents""",
    "parquet_file": nested_orders(),
    "json_flat_repeated_keys": f"SELECT '{{' || {LINE_MEMBERS} || '}}' AS json FROM lineitem",
    "custom_lookup_udf": """
SELECT o_orderkey AS "OrderKey", CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open'
  ELSE o_orderstatus END AS "Status" FROM orders""",
    "render_text_types": f"""
SELECT event_id, CAST(user_id AS VARCHAR) AS whole, {number("value")} AS floating,
  CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) AS money,
  CAST(event_type = 'click' AS VARCHAR) AS flag,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0' AS at,
  {day("ts")} AS day, to_base64(encode(props)) AS bytes
FROM events""",
    "parse_text_types": """
SELECT event_id, user_id AS whole, TRUE AS whole_ok, CAST(NULL AS INTEGER) AS kind, FALSE AS kind_ok,
  CAST(value AS DECIMAL(18, 2)) AS money, TRUE AS money_ok, event_type = 'click' AS flag,
  TRUE AS flag_ok, ts AS at, TRUE AS at_ok, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, TRUE AS day_ok
FROM events""",
    "csv_lines_flat": f"""
SELECT doc_id || ',' || {csv("lang")} || ',' || {csv("source")} || ',' || {csv("text")} AS text
FROM documents""",
    "csv_bundle_root": f"""
SELECT rn AS "RowNumber", rn || ',' || doc_id || ',' || {csv("lang")} || ',' || {csv("text")} AS text
FROM ({DOCUMENT_NUMBERS})""",
    "csv_bundle_child": f"""
SELECT row_number() OVER (ORDER BY rn, doc_id) AS "RowNumber",
  row_number() OVER (ORDER BY rn, doc_id) || ',' || rn || ',' || quality || ',' || toxic AS text
FROM labels JOIN ({DOCUMENT_NUMBERS}) USING (doc_id)""",
    "json_roots": f"""
WITH o AS (
  SELECT o_custkey, string_agg('{{' || {ORDER_MEMBERS} || '}}', ',' ORDER BY o_orderkey) AS listed
  FROM orders GROUP BY o_custkey
)
SELECT '{{' || {CUSTOMER_MEMBERS} || coalesce(',"Order":[' || listed || ']', '') || '}}' AS json
FROM customer LEFT JOIN o ON o_custkey = c_custkey""",
    "json_missing_child": f"""
SELECT '{{' || {DOCUMENT_MEMBERS} || coalesce(',"Label":[' || {LABEL_MEMBERS} || ']', '') || '}}' AS json
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "json_document": customer_json(),
    "xml_clean_text": """
SELECT doc_id, chr(65533) || text || chr(65533) || chr(9) AS clean FROM documents""",
    "xml_roots": f"""
SELECT '<Document><DocId>' || d.doc_id || '</DocId>' || {xml("Lang", "lang")} || {xml("Text", "text")}
  || coalesce('<Label><Quality>' || quality || '</Quality><Toxic>' || toxic || '</Toxic></Label>', '')
  || '</Document>' AS xml
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "xml_document": geography_xml(),
}
