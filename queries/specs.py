"""Export descriptions over the test tables."""


def entity(name, table, key, fields, parent_key=None, children=()):
    """``fields`` are (output name, column[, declared type[, lookup]])."""
    members = ("name", "column", "type", "lookup")
    return {
        "name": name,
        "table": table,
        "keyColumn": key,
        "parentKeyColumn": parent_key,
        "fields": [dict(zip(members, f)) for f in fields],
        "children": list(children),
    }


def flt(name, entity_name, field, operator="Equals", value_type="String", lookup=None):
    return {
        "name": name,
        "entity": entity_name,
        "field": field,
        "operator": operator,
        "valueType": value_type,
        "requestLookup": lookup,
    }


ORDER_FIELDS = [
    ("OrderKey", "o_orderkey", "Int64"),
    ("Status", "o_orderstatus"),
    ("Total", "o_totalprice", "Decimal"),
    ("OrderDate", "o_orderdate", "Date"),
    ("Priority", "o_orderpriority"),
]
CUSTOMER_FIELDS = [
    ("CustKey", "c_custkey", "Int64"),
    ("Name", "c_name"),
    ("Balance", "c_acctbal", "Decimal"),
    ("Segment", "c_mktsegment"),
]
# Test lines have no single key; these columns together are one.
LINE_KEY = [
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_shipdate",
]

ORDER_FILTERS = [
    flt("status", "Order", "Status"),
    flt("priorities", "Order", "Priority", "In"),
    flt("minTotal", "Order", "Total", "GreaterThanOrEqual", "Decimal"),
    flt("until", "Order", "OrderDate", "LessThanOrEqual", "Date"),
    flt("dates", "Order", "OrderDate", "Between", "Date"),
    flt("keys", "Order", "OrderKey", "In", "Int64"),
    flt("noStatus", "Order", "Status", "IsNull"),
    flt("anyStatus", "Order", "Status", "IsNotNull"),
]


def orders_entity(children=()):
    return entity("Order", "orders", "o_orderkey", ORDER_FIELDS, "o_custkey", children)


def lines_entity():
    fields = [
        ("LineNumber", "l_linenumber", "Int32"),
        ("PartKey", "l_partkey", "Int64"),
        ("Quantity", "l_quantity", "Decimal"),
        ("Shipped", "l_shipdate", "Date"),
    ]
    return entity("Line", "lineitem", LINE_KEY, fields, "l_orderkey")


# An order's lines share this key.
LINES_BY_ORDER = {
    "name": "lines",
    "root": lines_entity() | {"keyColumn": "l_orderkey", "parentKeyColumn": None},
}
FLAT_ORDERS = {
    "name": "orders",
    "root": entity("Order", "orders", "o_orderkey", ORDER_FIELDS),
    "filters": ORDER_FILTERS,
}

CUSTOMER_ORDERS = {
    "name": "customers",
    "root": entity("Customer", "customer", "c_custkey", CUSTOMER_FIELDS, children=[orders_entity()]),
    "filters": [flt("segment", "Customer", "Segment"), *ORDER_FILTERS],
}

CUSTOMER_LINES = {
    "name": "customers",
    "root": entity(
        "Customer", "customer", "c_custkey", CUSTOMER_FIELDS,
        children=[orders_entity([lines_entity()])],
    ),
}

CUSTOMER_ACTIVITY = {
    "name": "activity",
    "root": entity(
        "Customer", "customer", "c_custkey", CUSTOMER_FIELDS[:2],
        children=[
            orders_entity(),
            entity(
                "Event", "events", "event_id",
                [("EventId", "event_id", "Int64"), ("Kind", "event_type"), ("At", "ts", "DateTime")],
                "user_id",
            ),
        ],
    ),
}

GEOGRAPHY = {
    "name": "geography",
    "root": entity(
        "Region", "region", "r_regionkey", [("Region", "r_name")],
        children=[
            entity(
                "Nation", "nation", "n_nationkey", [("Nation", "n_name")], "n_regionkey",
                [
                    entity(
                        "Customer", "customer", "c_custkey", CUSTOMER_FIELDS, "c_nationkey",
                        [orders_entity()],
                    ),
                    entity(
                        "Supplier", "supplier", "s_suppkey",
                        [("SuppKey", "s_suppkey", "Int64"), ("Name", "s_name")], "s_nationkey",
                    ),
                ],
            )
        ],
    ),
}

CUSTOMERS_BY_NATION = {
    "name": "customers",
    "root": entity(
        "Customer", "customer", "c_custkey",
        [("CustKey", "c_custkey", "Int64"), ("Nation", "c_nationkey", "String", "nations")],
    ),
    "filters": [flt("nation", "Customer", "Nation", "In", "String", "nations")],
}

ORDERS_BY_STATUS = {
    "name": "orders",
    "root": entity(
        "Order", "orders", "o_orderkey",
        [("OrderKey", "o_orderkey", "Int64"), ("Status", "o_orderstatus", "String", "words")],
    ),
}

DOCUMENTS = {
    "name": "documents",
    "root": entity(
        "Document", "documents", "doc_id",
        [("DocId", "doc_id", "Int64"), ("Lang", "lang"), ("Source", "source"), ("Text", "text")],
    ),
}

DOCUMENT_LABELS = {
    "name": "documents",
    "root": entity(
        "Document", "documents", "doc_id",
        [("DocId", "doc_id", "Int64"), ("Lang", "lang"), ("Text", "text")],
        children=[
            entity(
                "Label", "labels", "doc_id",
                [("Quality", "quality", "Int32"), ("Toxic", "toxic", "Int32")], "doc_id",
            )
        ],
    ),
}

CONVERSATIONS = {
    "name": "conversations",
    "root": entity(
        "Turn", "conversations", ["conv_id", "turn"],
        [("Conversation", "conv_id", "Int64"), ("Turn", "turn", "Int64"), ("Role", "role"), ("Said", "text")],
    ),
}
