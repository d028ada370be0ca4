"""Every operator of the library as a query over whole test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bough import ExportRun, FunctionLookup, code_list, parquet_tables, read_bundle, rebuild
from bough.functions.parse import parse_text
from bough.functions.render import text, xml_clean
from bough.operators.checks import key_violations
from bough.operators.staging import staging_path
from queries import specs


def run(spark: SparkSession, folder: str, spec, tables=None, **options) -> ExportRun:
    """A run over the test tables, some of them replaced."""
    read = parquet_tables(spark, folder)
    changed = tables or {}
    return ExportRun(
        spark, spec, lambda schema, table: changed.get(table) or read(schema, table), **options
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---- flat exports and filters ------------------------------------------------------------------


def flat_export(spark, folder):
    return run(spark, folder, specs.FLAT_ORDERS).rows(numbered=True)


def composite_key_export(spark, folder):
    return run(spark, folder, specs.CONVERSATIONS).rows(numbered=True)


def filtered_orders(**filters):
    def query(spark, folder):
        return run(spark, folder, specs.FLAT_ORDERS, filters=filters).rows()

    return query


def orders_with_gaps(spark, folder):
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return table(spark, folder, "orders").withColumn("o_orderstatus", status)


def filtered_gaps(**filters):
    def query(spark, folder):
        gaps = {"orders": orders_with_gaps(spark, folder)}
        return run(spark, folder, specs.FLAT_ORDERS, gaps, filters=filters).rows()

    return query


def filter_in_large(spark, folder):
    """More values than a plan should list, as a table that is joined."""
    large = table(spark, folder, "lineitem").where("l_quantity >= 40").select("l_orderkey")
    return run(spark, folder, specs.FLAT_ORDERS, filters={"keys": large}).rows()


# ---- levels ------------------------------------------------------------------------------------


def child_of_filtered_parent(spark, folder):
    chosen = run(spark, folder, specs.CUSTOMER_ORDERS, filters={"segment": "BUILDING"})
    return chosen.level("Order")


def exploded_orders(nested: DataFrame) -> DataFrame:
    """Nested customers as rows, customers without orders included."""
    return nested.select("CustKey", F.posexplode_outer("Order").alias("Position", "o")).select(
        "CustKey",
        F.col("Position").cast("long").alias("Position"),
        "o.OrderKey",
        "o.Status",
        "o.OrderDate",
    )


def child_filter_keeps_parents(spark, folder):
    return exploded_orders(run(spark, folder, specs.CUSTOMER_ORDERS, filters={"status": "F"}).nested())


def null_and_orphan_keys_drop(spark, folder):
    owner = (
        F.when(F.col("o_orderstatus") == "P", F.lit(None))
        .when(F.col("o_orderpriority") == "5-LOW", -1 - F.col("o_custkey"))
        .otherwise(F.col("o_custkey"))
    )
    orders = table(spark, folder, "orders").withColumn("o_custkey", owner)
    return run(spark, folder, specs.CUSTOMER_ORDERS, {"orders": orders}).level("Order")


def level_transform(spark, folder):
    def shout(name: str, df: DataFrame) -> DataFrame:
        field = {"Customer": "Name", "Order": "Priority"}[name]
        return df.withColumn(field, F.upper(field) if name == "Customer" else F.lower(field))

    nested = run(spark, folder, specs.CUSTOMER_ORDERS, transform=shout).nested()
    return nested.select("Name", F.explode("Order").alias("o")).select(
        "Name", "o.OrderKey", "o.Priority"
    )


def numbered(spec, name, *fields):
    def query(spark, folder):
        level = run(spark, folder, spec).numbered_level(name)
        return level.select("RowNumber", "ParentRowNumber", *fields)

    return query


# ---- trees -------------------------------------------------------------------------------------


def nest_two_levels(spark, folder):
    return exploded_orders(run(spark, folder, specs.CUSTOMER_ORDERS).nested())


def nest_three_levels(spark, folder):
    nested = run(spark, folder, specs.CUSTOMER_LINES).nested()
    orders = nested.select("CustKey", F.explode("Order").alias("o"))
    lines = orders.select("CustKey", "o.OrderKey", F.posexplode_outer("o.Line").alias("Position", "l"))
    return lines.select(
        "CustKey",
        "OrderKey",
        F.col("Position").cast("long").alias("Position"),
        "l.LineNumber",
        "l.PartKey",
        "l.Quantity",
    )


def nest_siblings(spark, folder):
    nested = run(spark, folder, specs.CUSTOMER_ACTIVITY).nested()
    orders = F.transform("Order", lambda o: o["OrderKey"].cast("string"))
    events = F.transform("Event", lambda e: F.concat_ws(":", e["EventId"].cast("string"), e["Kind"]))
    return nested.select(
        "CustKey", F.array_join(orders, ",").alias("Orders"), F.array_join(events, ",").alias("Events")
    )


def rebuild_from_numbers(spark, folder):
    orders = run(spark, folder, specs.CUSTOMER_ORDERS)
    return exploded_orders(rebuild(orders.export, orders.numbered()))


def bundle_round_trip(spark, folder):
    orders = run(spark, folder, specs.CUSTOMER_ORDERS)
    path = staging_path(spark, "bundle")
    orders.write(path, "csv")
    levels = read_bundle(spark, path, orders.export, decimal=(18, 2))
    return exploded_orders(rebuild(orders.export, levels))


def row_counts(spark, folder):
    return run(spark, folder, specs.GEOGRAPHY).row_counts()


def key_violations_of_lines(spark, folder):
    return key_violations(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


# ---- lookups -----------------------------------------------------------------------------------


def region_list(spark, folder, region="EUROPE"):
    return code_list(
        table(spark, folder, "nation"),
        table(spark, folder, "region"),
        region,
        id_column="n_nationkey",
        code_column="n_name",
        type_id_column="n_regionkey",
        types_id_column="r_regionkey",
        type_name_column="r_name",
    )


def every_nation(spark, folder):
    return table(spark, folder, "nation").selectExpr("n_nationkey AS id", "n_name AS code")


def lookup_render(spark, folder):
    nations = {"nations": every_nation(spark, folder)}
    return run(spark, folder, specs.CUSTOMERS_BY_NATION, lookups=nations).rows()


def lookup_miss_passes_raw(spark, folder):
    nations = {"nations": region_list(spark, folder)}
    return run(spark, folder, specs.CUSTOMERS_BY_NATION, lookups=nations).rows()


def lookup_null_stays_null(spark, folder):
    known = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey"))
    customers = {"customer": table(spark, folder, "customer").withColumn("c_nationkey", known)}
    nations = {"nations": every_nation(spark, folder)}
    return run(spark, folder, specs.CUSTOMERS_BY_NATION, customers, lookups=nations).rows()


def lookup_in_json(spark, folder):
    nations = {"nations": region_list(spark, folder)}
    return run(spark, folder, specs.CUSTOMERS_BY_NATION, lookups=nations).json_rows()


def filter_by_readable_value(spark, folder):
    return run(
        spark,
        folder,
        specs.CUSTOMERS_BY_NATION,
        lookups={"nations": every_nation(spark, folder)},
        filters={"Nation": ["nation_3", "Nation_20"]},
    ).rows()


def custom_lookup_udf(spark, folder):
    # None leaves the value as it is.
    words = FunctionLookup(render=lambda ids: ids.map({"F": "finished", "O": "open"}))
    return run(spark, folder, specs.ORDERS_BY_STATUS, lookups={"words": words}).rows()


def custom_request_lookup(spark, folder):
    """Python reads filter values and writes codes."""
    nations = FunctionLookup(
        render=lambda ids: "No. " + ids, request=lambda given: given.lower().removeprefix("nation_")
    )
    return run(
        spark,
        folder,
        specs.CUSTOMERS_BY_NATION,
        lookups={"nations": nations},
        filters={"Nation": ["nation_3", "Nation_20"]},
    ).rows()


# ---- text --------------------------------------------------------------------------------------


def render_text_types(spark, folder):
    events = table(spark, folder, "events")

    def shown(name: str, value, dtype: str, declared: str = "String"):
        return text(value.cast(dtype), T.DataType.fromDDL(dtype), declared).alias(name)

    c = F.col
    return events.select(
        "event_id",
        shown("whole", c("user_id"), "bigint"),
        shown("floating", c("value"), "double"),
        shown("money", c("value"), "decimal(18,2)"),
        shown("flag", c("event_type") == "click", "boolean"),
        shown("at", c("ts"), "timestamp_ntz", "DateTime"),
        shown("day", c("ts"), "timestamp_ntz", "Date"),
        shown("bytes", c("props"), "binary"),
    )


def parse_text_types(spark, folder):
    events = table(spark, folder, "events")
    texts = {
        "whole": ("Int64", F.concat(F.lit(" "), F.col("user_id").cast("string"))),
        "kind": ("Int32", F.col("event_type")),
        "money": ("Decimal", F.col("value").cast("string")),
        "flag": ("Boolean", F.upper((F.col("event_type") == "click").cast("string"))),
        "at": ("DateTime", F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T"))),
        "day": ("Date", F.substring(F.col("ts").cast("string"), 1, 10)),
    }
    columns = [F.col("event_id")]
    for name, (declared, raw) in texts.items():
        parsed = parse_text(raw, declared, (18, 2))
        columns += [parsed["value"].alias(name), parsed["ok"].alias(f"{name}_ok")]
    return events.select(*columns)


def parse_long_decimals(spark, folder):
    """28 digits are read exactly; a text with more digits after the point than there is room for
    does not fit."""
    events = table(spark, folder, "events")
    fraction = F.lpad(F.col("user_id").cast("string"), 18, "0")
    whole = F.concat((F.col("event_id") % 1000).cast("string"), F.lit("1234567"))
    columns = [F.col("event_id")]
    for name, raw in (
        ("long", F.concat(whole, F.lit("."), fraction)),
        ("small", F.concat(F.lit("-1"), fraction, F.lit("e-18"))),
        ("over", F.concat(whole, F.lit("."), fraction, F.lit("1"))),
    ):
        parsed = parse_text(raw, "Decimal", (38, 18))
        columns += [parsed["value"].cast("string").alias(name), parsed["ok"].alias(f"{name}_ok")]
    return events.select(*columns)


def csv_lines_flat(spark, folder):
    return run(spark, folder, specs.DOCUMENTS).csv_lines().select("text")


def csv_bundle(name):
    def query(spark, folder):
        return run(spark, folder, specs.DOCUMENT_LABELS).csv_lines(name)

    return query


def json_roots(spark, folder):
    return run(spark, folder, specs.CUSTOMER_ORDERS).json_rows()


def json_missing_child(spark, folder):
    return run(spark, folder, specs.DOCUMENT_LABELS).json_rows()


def xml_clean_text(spark, folder):
    dirty = F.concat(F.char(F.lit(1)), F.col("text"), F.char(F.lit(11)), F.char(F.lit(9)))
    return table(spark, folder, "documents").select("doc_id", xml_clean(dirty).alias("clean"))


def xml_roots(spark, folder):
    return run(spark, folder, specs.DOCUMENT_LABELS).xml_rows()


def document_pieces(format, spec):
    """Every piece of a document with its place, the places renamed in their order."""

    def query(spark, folder):
        pieces, order = run(spark, folder, spec).document(format)
        places = []
        for i, name in enumerate(order):
            whole = isinstance(pieces.schema[name].dataType, T.IntegerType)
            place = F.col(f"`{name}`")
            places.append((place.cast("long") if whole else place).alias(f"place_{i}"))
        return pieces.select(*places, "text")

    return query


# ---- finished outputs --------------------------------------------------------------------------


def flat_csv_file(spark, folder):
    """The lines of a written file, its header among them."""
    path = staging_path(spark, "flat-csv")
    run(spark, folder, specs.DOCUMENTS).write(path, "csv")
    return spark.read.option("lineSep", "\r\n").text(path).withColumnRenamed("value", "text")


def parquet_file(spark, folder):
    path = staging_path(spark, "nested-parquet")
    run(spark, folder, specs.CUSTOMER_ORDERS).write(path, "parquet")
    return exploded_orders(spark.read.parquet(path))


def json_flat_repeated_keys(spark, folder):
    """The records of a written document whose key repeats, each without the comma before it."""
    path = staging_path(spark, "flat-json")
    run(spark, folder, specs.LINES_BY_ORDER).write(path, "json")
    lines = spark.read.text(path).where(~F.col("value").isin("[", "]"))
    return lines.select(F.regexp_replace("value", "^,", "").alias("json"))


QUERIES = {
    "flat_export": flat_export,
    "composite_key_export": composite_key_export,
    "filter_equals": filtered_orders(status="F"),
    "filter_in": filtered_orders(priorities=["1-URGENT", "2-HIGH"]),
    "filter_gte": filtered_orders(minTotal="250000.50"),
    "filter_lte": filtered_orders(until="1997-06-30"),
    "filter_between": filtered_orders(dates=["1996-01-01", "1996-12-31"]),
    "filter_in_large": filter_in_large,
    "filter_is_null": filtered_gaps(noStatus=None),
    "filter_is_not_null": filtered_gaps(anyStatus=None),
    "filter_conjunction": filtered_orders(status="O", minTotal="1e5", until="1998-12-31"),
    "child_of_filtered_parent": child_of_filtered_parent,
    "child_filter_keeps_parents": child_filter_keeps_parents,
    "null_and_orphan_keys_drop": null_and_orphan_keys_drop,
    "level_transform": level_transform,
    "number_root": numbered(specs.CUSTOMER_ORDERS, "Customer", "CustKey", "Name"),
    "number_child": numbered(specs.CUSTOMER_ORDERS, "Order", "OrderKey", "Status"),
    "number_grandchild": numbered(specs.GEOGRAPHY, "Customer", "CustKey", "Name"),
    "number_fourth_level": numbered(specs.GEOGRAPHY, "Order", "OrderKey"),
    "nest_two_levels": nest_two_levels,
    "nest_three_levels": nest_three_levels,
    "nest_four_levels": document_pieces("json", specs.GEOGRAPHY),
    "nest_siblings": nest_siblings,
    "rebuild_from_numbers": rebuild_from_numbers,
    "bundle_round_trip": bundle_round_trip,
    "row_counts": row_counts,
    "key_violations": key_violations_of_lines,
    "code_list_scan": region_list,
    "lookup_render": lookup_render,
    "lookup_miss_passes_raw": lookup_miss_passes_raw,
    "lookup_null_stays_null": lookup_null_stays_null,
    "lookup_in_json": lookup_in_json,
    "filter_by_readable_value": filter_by_readable_value,
    "custom_lookup_udf": custom_lookup_udf,
    "custom_request_lookup": custom_request_lookup,
    "render_text_types": render_text_types,
    "parse_text_types": parse_text_types,
    "parse_long_decimals": parse_long_decimals,
    "flat_csv_file": flat_csv_file,
    "parquet_file": parquet_file,
    "json_flat_repeated_keys": json_flat_repeated_keys,
    "csv_lines_flat": csv_lines_flat,
    "csv_bundle_root": csv_bundle("Document"),
    "csv_bundle_child": csv_bundle("Label"),
    "json_roots": json_roots,
    "json_missing_child": json_missing_child,
    "json_document": document_pieces("json", specs.CUSTOMER_LINES),
    "xml_clean_text": xml_clean_text,
    "xml_roots": xml_roots,
    "xml_document": document_pieces("xml", specs.GEOGRAPHY),
}
