"""A star schema of customers, suppliers, parts and orders, read as a lending collection.

Every row of the source tables takes part. The mapping plants rows that break the rules, so that
the quality checks have something to find: malformed emails and phones, repeated and hyphenated
ISBNs, page counts of zero, acquisition dates ahead of the "as of" date, shelves whose recorded
count is off by one, books with several open loans and loans without a book.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.schemas import BOOKS, LOANS, SHELVES, STUDENTS
from lectern.sources.collection import Collection

AS_OF = date(2001, 8, 2)

# Declared, so that opening a table reads no file footers.
SOURCES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
    "props string",
}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCES[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _mapped(df: DataFrame, schema: T.StructType, **columns: str) -> DataFrame:
    """``df`` as rows of ``schema``, each column cast from its SQL expression."""
    stamp = "timestamp_ntz'2001-01-01 00:00:00'"
    columns |= {"created_at": stamp, "updated_at": stamp}
    return df.selectExpr(
        *[f"CAST({columns[f.name]} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema]
    )


def students(customer: DataFrame) -> DataFrame:
    return _mapped(
        customer,
        STUDENTS,
        student_id="c_custkey",
        student_number="'20' || substr(c_name, 10)",
        first_name="'Customer'",
        last_name="substr(c_name, 10)",
        email="""'customer.' || substr(c_name, 10)
            || IF(c_custkey % 50 = 0, '_at_example', '@example.org')""",
        phone="""CASE WHEN c_custkey % 3 = 0 THEN NULL
            WHEN c_custkey % 25 = 1 THEN 'ext ' || c_custkey
            ELSE '+1-555-' || lpad(string(c_custkey % 10000), 4, '0') END""",
        program="c_mktsegment",
        enrollment_year="2015 + c_custkey % 10",
        status="""CASE WHEN c_acctbal < 0 THEN 'inactive' WHEN c_acctbal > 9000 THEN 'graduated'
            ELSE 'active' END""",
    )


def books(part: DataFrame, supplier: DataFrame) -> DataFrame:
    keyed = part.withColumn("shelf_count", supplier.agg(F.count("*")).scalar()).selectExpr(
        "*", "IF(p_partkey % 40 = 3, p_partkey - 1, p_partkey) AS isbn_of"
    )
    digits = keyed.selectExpr(
        "*",
        "lpad(string(isbn_of), 9, '0') AS digits",
        "IF(isbn_of % 11 = 10, 'X', string(isbn_of % 11)) AS mark",
    )
    return _mapped(
        digits,
        BOOKS,
        book_id="p_partkey",
        isbn="""CASE WHEN p_partkey % 5 = 4 THEN NULL
            WHEN p_partkey % 60 = 7 THEN '978-' || digits || '-' || mark
            ELSE '978' || digits || mark END""",
        title="p_name",
        author="p_brand",
        publisher="p_type",
        publication_year="1950 + p_size",
        edition="(1 + p_partkey % 5) || ' ed.'",
        language="CASE p_partkey % 4 WHEN 0 THEN 'Spanish' WHEN 1 THEN 'English' "
        "WHEN 2 THEN 'French' END",
        pages="IF(p_partkey % 200 = 0, 0, 50 + p_partkey % 950)",
        book_type="IF(p_partkey % 10 = 0, 'digital', 'physical')",
        shelf_id="IF(p_partkey % 10 = 0, NULL, p_partkey % shelf_count)",
        status="""CASE WHEN p_partkey % 97 = 0 THEN 'lost' WHEN p_partkey % 31 = 0
            THEN 'maintenance' WHEN p_partkey % 3 = 0 THEN 'loaned' ELSE 'available' END""",
        acquisition_date="date_add(date'1995-01-01', int(p_partkey % 3000))",
    )


def shelves(
    supplier: DataFrame, nation: DataFrame, region: DataFrame, catalogue: DataFrame
) -> DataFrame:
    placed = (
        catalogue.where("book_type = 'physical'")
        .groupBy("shelf_id")
        .agg(F.count("*").alias("placed"))
    )
    located = (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .join(placed, F.col("s_suppkey") == F.col("shelf_id"), "left")
        .selectExpr(
            "s_suppkey", "s_name", "n_name", "r_name",
            "coalesce(placed, 0) + IF(s_suppkey % 7 = 0, 1, 0) AS recorded",
        )
    )
    return _mapped(
        located,
        SHELVES,
        shelf_id="s_suppkey",
        location_code="s_name",
        section="n_name",
        main_topic="r_name",
        material="CASE s_suppkey % 6 WHEN 0 THEN 'Wood' WHEN 1 THEN 'Metal' WHEN 2 THEN 'Plastic' "
        "WHEN 3 THEN 'Cardboard' END",
        total_capacity="greatest(1, recorded + 5 * (s_suppkey % 8))",
        current_book_count="recorded",
    )


def loans(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    first_line = lineitem.groupBy("l_orderkey").agg(F.min("l_partkey").alias("book_id"))
    return _mapped(
        orders.join(first_line, F.col("o_orderkey") == F.col("l_orderkey"), "left"),
        LOANS,
        loan_id="o_orderkey",
        book_id="book_id",
        student_id="o_custkey",
        loan_date="o_orderdate",
        estimated_return_date="date_add(date(o_orderdate), IF(book_id % 10 = 0, 7, 14))",
        actual_return_date="""IF(o_orderstatus = 'F',
            date_add(date(o_orderdate), int(1 + o_orderkey % 30)), NULL)""",
        loan_status="""CASE WHEN o_orderstatus = 'F' THEN 'returned' WHEN o_orderstatus = 'P'
            THEN 'active' WHEN o_orderkey % 20 = 0 THEN 'lost' ELSE 'overdue' END""",
        renewal_count="o_orderkey % 4",
        notes="NULL",
    )


def read_star(spark: SparkSession, sf_dir: str) -> Collection:
    def table(name: str) -> DataFrame:
        return source(spark, sf_dir, name)

    tables = Collection(
        students=lambda: students(table("customer")),
        shelves=lambda: shelves(
            table("supplier"), table("nation"), table("region"), tables.books
        ),
        books=lambda: books(table("part"), table("supplier")),
        loans=lambda: loans(table("orders"), table("lineitem")),
    )
    return tables
