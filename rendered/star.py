"""A Java tree rendered from a star schema's rows: one file per region, nation, supplier and customer.

Its structure follows from the foreign keys, so every analysis of the rendered
text can be checked against a plain relational query over the same tables.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_REGION = """package com.acme.region;
import javax.persistence.EntityManager;
/** Keeps region {r}. */
@Repository
public class RegionStore{r} {
    public void load() {}
}
"""
_NATION = """package com.acme.nation;
import com.acme.region.RegionStore{r};
@Service
public class NationService{n} {
    private RegionStore{r} store;
    void resolve() { store.load(); }
}
"""
_SUPPLIER = """package com.acme.supplier;
import com.acme.nation.NationService{n};
@RestController
@RequestMapping("/suppliers")
public class SupplierApi{s} {
    private NationService{n} service;
    @GetMapping("/{s}")
    public void get() { service.resolve(); }
}
"""
_CUSTOMER = """package com.acme.customer;
import com.acme.nation.NationService{n};
import {library};
/**
 * Customer number {c}.
 * @since 1
 */
@Entity
public class Customer{c}{heritage} {
{member}
}
"""


def render(template: str, **values):
    """Template with `{name}` holes -> concat of literals and columns."""
    parts, rest = [], template
    while rest:
        at = min((rest.find("{" + k + "}") for k in values if "{" + k + "}" in rest), default=-1)
        if at < 0:
            parts.append(F.lit(rest))
            break
        key = rest[at + 1 : rest.index("}", at)]
        parts += [F.lit(rest[:at]), values[key].cast("string")]
        rest = rest[at + len(key) + 2 :]
    return F.concat(*parts)


def dealt(rows: DataFrame, times: int = 1) -> DataFrame:
    """Rows over all tasks: each becomes a file to parse, while a table of them is small and may lie in one row group.

    Rows of several kinds are best dealt together, `times` as finely: dealt kind by kind, those of the lesser ones make
    tasks, and files of the parsed table, with next to nothing in them, and readers pack such files like full ones.
    """
    spark = rows.sparkSession
    return rows.repartition(times * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def star_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the rendered tree."""

    def read(table):
        return spark.read.parquet(f"{folder}/{table}.parquet")

    def path(package, name, key):
        return F.concat(F.lit(f"src/main/java/com/acme/{package}/{name}"), F.col(key).cast("string"), F.lit(".java"))

    def files(table, name, key, template, **values):
        return read(table).select(path(table, name, key).alias("path"), render(template, **values).cast("binary").alias("content"))

    def rows(table, key, nation):
        return read(table).select(F.lit(table).alias("kind"), F.col(key).alias("key"), F.col(nation).alias("nation"))

    c, nation = F.col("key"), F.col("nation").cast("string")
    service = F.concat(F.lit("NationService"), nation)
    library = (
        F.when(c % 3 == 0, "java.util.List")
        .when(c % 3 == 1, "okhttp3.OkHttpClient")
        .otherwise("org.apache.kafka.clients.producer.KafkaProducer")
    )
    heritage = (
        F.when(c % 6 == 4, F.concat(F.lit(" extends "), service))
        .when(c % 6 == 5, F.concat(F.lit(" implements "), service))
        .otherwise("")
    )
    member = (
        F.when(c % 6 == 0, F.concat(F.lit("    private "), service, F.lit(" owner;")))
        .when(c % 6 == 1, F.concat(F.lit("    void accept("), service, F.lit(" owner) {}")))
        .when(c % 6 == 2, F.concat(F.lit("    "), service, F.lit(" owner() { return null; }")))
        .when(c % 6 == 3, F.concat(F.lit("    void make() { Object o = new "), service, F.lit("(); }")))
        .otherwise("    private String name;")
    )
    is_supplier = F.col("kind") == "supplier"
    many = dealt(rows("supplier", "s_suppkey", "s_nationkey").unionByName(rows("customer", "c_custkey", "c_nationkey")), 2)
    text = F.when(is_supplier, render(_SUPPLIER, n=nation, s=c)).otherwise(
        render(_CUSTOMER, n=nation, c=c, library=library, heritage=heritage, member=member)
    )
    place = F.when(is_supplier, path("supplier", "SupplierApi", "key")).otherwise(path("customer", "Customer", "key"))
    return (
        files("region", "RegionStore", "r_regionkey", _REGION, r=F.col("r_regionkey"))
        .unionByName(files("nation", "NationService", "n_nationkey", _NATION, r=F.col("n_regionkey"), n=F.col("n_nationkey")))
        .unionByName(many.select(place.alias("path"), text.cast("binary").alias("content")))
    )


def sql_text() -> str:
    """SQL for (path, text, package, n_imports) of the same files."""

    def files(table, package, name, key, n_imports, template, **values):
        text = "'" + template.replace("'", "''") + "'"
        for hole, value in values.items():
            text = text.replace("{" + hole + "}", f"' || {value} || '")
        path = f"'src/main/java/com/acme/{package}/{name}' || {key} || '.java'"
        return f"SELECT {path} AS path, {text} AS text, 'com.acme.{package}' AS package, {n_imports} AS n_imports FROM {table}"

    service = "'NationService' || c_nationkey"
    member = (
        f"CASE c_custkey % 6 WHEN 0 THEN '    private ' || {service} || ' owner;' "
        f"WHEN 1 THEN '    void accept(' || {service} || ' owner) {{}}' "
        f"WHEN 2 THEN '    ' || {service} || ' owner() {{ return null; }}' "
        f"WHEN 3 THEN '    void make() {{ Object o = new ' || {service} || '(); }}' ELSE '    private String name;' END"
    )
    heritage = (
        f"CASE c_custkey % 6 WHEN 4 THEN ' extends ' || {service} WHEN 5 THEN ' implements ' || {service} ELSE '' END"
    )
    library = (
        "CASE c_custkey % 3 WHEN 0 THEN 'java.util.List' WHEN 1 THEN 'okhttp3.OkHttpClient' "
        "ELSE 'org.apache.kafka.clients.producer.KafkaProducer' END"
    )
    return " UNION ALL ".join(
        [
            files("region", "region", "RegionStore", "r_regionkey", 1, _REGION, r="r_regionkey"),
            files("nation", "nation", "NationService", "n_nationkey", 1, _NATION, r="n_regionkey", n="n_nationkey"),
            files("supplier", "supplier", "SupplierApi", "s_suppkey", 1, _SUPPLIER, n="s_nationkey", s="s_suppkey"),
            files("customer", "customer", "Customer", "c_custkey", 2, _CUSTOMER,
                  n="c_nationkey", c="c_custkey", library=library, heritage=heritage, member=member),
        ]
    )


# -- a second tree: tasks that work through interfaces ---------------------------------------

_BASE = {
    "BaseTask": "package com.acme.base;\npublic abstract class BaseTask {\n}\n",
    "Money": "package com.acme.base;\npublic record Money(long cents) {\n    void add() {}\n}\n",
    "Meter": "package com.acme.base;\nimport java.sql.Connection;\n@Service\npublic class Meter {\n    void read() {}\n}\n",
}
_PORT = "package com.acme.port;\npublic interface Port{p} {\n    String quote();\n}\n"
_ADAPTER = """package com.acme.adapter;
import com.acme.base.Meter;
import com.acme.port.Port{p};
public class {kind}{p} implements Port{p} {
    private Meter meter;
    public String quote() { meter.read(); return "q"; }
}
"""
_TASK = """package com.acme.task;
import com.acme.base.BaseTask;
import com.acme.base.Money;
import com.acme.port.*;
public class StockTask{p} extends BaseTask {
    private Money total;
{fields}
    public void run() {
        total.add();
{calls}
    }
    public void run(int times) { total.add(); }
}
"""


def port_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content): per part an interface, its adapters (two for every fifth part), and a task.

    A task quotes the ports of up to fifteen parts before its own, so that flows
    meet the step limit; every task has the same base class, which is therefore
    the target of a large share of all edges.
    """
    part = dealt(spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", "p_size"))
    p = F.col("p_partkey")
    lines = F.transform(
        F.sequence(F.lit(1), F.col("p_size") % 15 + 1),
        lambda i: F.struct(i.cast("string").alias("i"), F.greatest(p - i, F.lit(0)).cast("string").alias("port")),
    )
    fields = F.array_join(
        F.transform(lines, lambda x: F.concat(F.lit("    private com.acme.port.Port"), x["port"], F.lit(" line"), x["i"], F.lit(";"))), "\n"
    )
    calls = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("        line"), x["i"], F.lit(".quote();"))), "\n")

    def files(package, name, template, rows=part, **values):
        path = F.concat(F.lit(f"src/main/java/com/acme/{package}/{name}"), p.cast("string"), F.lit(".java"))
        return rows.select(path.alias("path"), render(template, p=p, **values).cast("binary").alias("content"))

    base = spark.createDataFrame([(f"src/main/java/com/acme/base/{n}.java", t.encode()) for n, t in _BASE.items()], "path string, content binary").coalesce(1)
    return (
        files("port", "Port", _PORT)
        .unionByName(files("adapter", "Adapter", _ADAPTER, kind=F.lit("Adapter")))
        .unionByName(files("adapter", "Backup", _ADAPTER, part.filter(p % 5 == 0), kind=F.lit("Backup")))
        .unionByName(files("task", "StockTask", _TASK, fields=fields, calls=calls))
        .unionByName(base)
    )
