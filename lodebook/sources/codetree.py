"""Source files written from the rows of the given tables, one file per row.

Orders become Python, customers TypeScript, suppliers Java and parts Go. The tree grows
with the tables, and what extraction must find in it follows from the rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodebook.sources.tables import read_table

PYTHON_FILE = """\
import os, json as js
from customers import customer_%1$d

class Order%2$d(Base):
    status = '%3$s'

    @property
    def total(self, rate=1) -> float:
        return js.dump(customer_%1$d(rate))

async def ship_%2$d(x):
    return Order%2$d(x).total()"""

TYPESCRIPT_FILE = """\
import { base } from './base';
// customer_%1$d(old) is gone
export class Customer%1$d extends Base {
  segment = '%3$s';
  static async load(id, qty = 1) {
    return nation_%2$d(id);
  }
}
export const customer_%1$d = (rate) => {
  return new Customer%1$d(rate);
};
export default Customer%1$d;"""

JAVA_FILE = """\
package suppliers;
import java.util.List;
public class Supplier%1$d {
    public int quote(int qty) {
        return rate_%2$d(qty);
    }
}"""

GO_FILE = """\
package parts

func Part%1$d(size int) int {
  return check(size, %2$d)
}
type Box%1$d struct {
  size int
}"""


KEYS = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus"], "customer": ["c_custkey", "c_nationkey", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey", "p_size"],
}


FILES_PER_TASK = 50_000


def dealt(rows: DataFrame, key: str, files: int = 1) -> DataFrame:
    """Narrow rows, of which each becomes `files` files, dealt out by key: a small table would stay in one task, and a
    fixed number of tasks would grow with the input."""
    tasks = -(-rows.count() * files // FILES_PER_TASK)
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, tasks), key)


def keys_of(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The few narrow columns that contents are made from, dealt out before the contents exist."""
    columns = KEYS[table]
    return dealt(read_table(spark, folder, table).select(*columns), columns[0])


def filled(template: str, *names: str) -> Column:
    """`F.format_string` of columns, which parses its template for every row; null is written as null."""
    parts = re.split(r"%(\d)\$[ds]", template)
    return F.concat(*[
        F.lit(part) if place % 2 == 0 else F.coalesce(F.col(names[int(part) - 1]).cast("string"), F.lit("null"))
        for place, part in enumerate(parts)])


def _file(table: DataFrame, path: Column, content: Column, language: str) -> DataFrame:
    return table.select(
        path.alias("file_id"), path.alias("path"), path.alias("relative_path"), content.alias("content"),
        F.lit(language).alias("language"))


def python_files(spark: SparkSession, folder: str) -> DataFrame:
    orders = keys_of(spark, folder, "orders")
    path = filled("src/orders/order_%1$d.py", "o_orderkey")
    return _file(
        orders, path, filled(PYTHON_FILE, "o_custkey", "o_orderkey", "o_orderstatus"), "python")


def typescript_files(spark: SparkSession, folder: str) -> DataFrame:
    customers = keys_of(spark, folder, "customer")
    path = filled("src/customers/customer_%1$d.ts", "c_custkey")
    return _file(
        customers, path, filled(TYPESCRIPT_FILE, "c_custkey", "c_nationkey", "c_mktsegment"), "typescript")


def java_files(spark: SparkSession, folder: str) -> DataFrame:
    suppliers = keys_of(spark, folder, "supplier")
    path = filled("src/suppliers/Supplier%1$d.java", "s_suppkey")
    return _file(suppliers, path, filled(JAVA_FILE, "s_suppkey", "s_nationkey"), "java")


def go_files(spark: SparkSession, folder: str) -> DataFrame:
    parts = keys_of(spark, folder, "part")
    path = filled("src/parts/part_%1$d_test.go", "p_partkey")
    return _file(parts, path, filled(GO_FILE, "p_partkey", "p_size"), "go")


def all_files(spark: SparkSession, folder: str) -> DataFrame:
    return (
        python_files(spark, folder).unionByName(typescript_files(spark, folder))
        .unionByName(java_files(spark, folder)).unionByName(go_files(spark, folder))
    )
