"""Directory-shaped tables derived from customer, orders and documents, by expressions that are plain SQL.

The same texts build the inputs of the queries (selectExpr) and of the SQL they are held against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-06-30 00:00:00"


def div(a: str, n: int) -> str:
    return f"cast(floor(({a}) / {n}) as bigint)"


def pick(index: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"(CASE {index} {whens} END)"


def quoted(values: list[str]) -> list[str]:
    return ["'" + v.replace("'", "''") + "'" for v in values]


def luhn(nine: str) -> str:
    """The tenth digit of nine digits, as SQL."""
    d = [f"cast(substr({nine}, {i}, 1) as int)" for i in range(1, 10)]
    doubled = " + ".join(f"(2 * {x} - CASE WHEN {x} > 4 THEN 9 ELSE 0 END)" for x in d[0::2])
    return f"((10 - (24 + {doubled} + {' + '.join(d[1::2])}) % 10) % 10)"


FIRST = quoted(["James", "Maria", "Wei", "Aisha", "John", "Elena", "Omar", "Priya", "Liam", "Sofia", "Noah", "Grace"])
LAST = quoted(["Smith", "O'Connor", "Al-Hassan", "Garcia", "Chen", "Khan", "Brown", "Lopez", "Ivanov", "Patel", "Kim", "Rossi", "Novak", "Silva", "Adams"])
CITY = quoted(["New York", "brooklyn", "ALBANY", "Buffalo", "O'Fallon", "Yonkers"])
STATE = quoted(["NY", "FL", "Florida", "tx", "Texas", "CA"])
SPECIALTY = quoted(["Pediatric Allergy", "Internal  Medicine", "Family Medicine", "General Practice"])
TAXONOMY = quoted(["207rc0000x", "207R00000X", "207Q00000X", "208d00000x"])

KEYS = {"k": "c_custkey", "j": div("c_custkey", 10), "kk": "CASE WHEN c_custkey % 50 IN (1, 3) THEN c_custkey - 1 ELSE c_custkey END",
        "ka": "CASE WHEN c_custkey % 50 = 3 THEN c_custkey - 1 ELSE c_custkey END",
        "kp": "CASE WHEN c_custkey % 50 = 1 THEN c_custkey - 1 ELSE c_custkey END", "nine": "concat('1', lpad(cast(c_custkey as string), 8, '0'))"}
_P = "lpad(cast((kp * 7919 + 1234567) % 10000000 as string), 7, '0')"
_A = "(CASE WHEN k % 4 = 0 THEN ka % 40 ELSE ka END)"
DIRECTORY = {
    "k": "k", "j": "j", "npi": f"concat(nine, cast({luhn('nine')} as string))",
    "name": f"concat({pick('k % 3', quoted(['', 'Dr. ', '']))}, {pick('kk % 12', FIRST)}, ' ', {pick(div('kk', 12) + ' % 15', LAST)}, {pick('k % 5', quoted(['', '', ', MD', '', '']))})",
    "phone": pick("k % 4", [f"concat('212', {_P})", f"concat('1-212-', substr({_P}, 1, 3), '-', substr({_P}, 4))", f"concat('(212) ', substr({_P}, 1, 3), '-', substr({_P}, 4))",
                            f"concat('+1 212.', substr({_P}, 1, 3), '.', substr({_P}, 4))"]),
    "street": f"concat(cast(100 + {_A} % 900 as string), ' ', {pick(_A + ' % 6', quoted(['N Park Ave', 'Main St', 'Orchard View Dr, Suite 210', 'E 47 St #5', 'Hudson Blvd', 'W 168th St Fl 3']))})",
    "city": pick(f"{_A} % 6", CITY), "state": pick(f"{_A} % 6", STATE),
    "zip": f"concat(cast(10000 + {_A} % 89999 as string), CASE WHEN k % 7 = 0 THEN '-1234' ELSE '' END)",
    "specialty": pick("k % 4", SPECIALTY), "taxonomy_code": pick("k % 4", TAXONOMY), "is_active": "CASE WHEN k % 97 = 0 THEN 0 ELSE 1 END",
    "age_days": "cast(k % 720 as int)",
}

_SEC = "(j % 5 = 4 AND o % 2 = 1)"
_CHANGES = {  # field: (remainders of k, first new value, second)
    "zip": ("2", "concat('9', lpad(cast(k % 10000 as string), 4, '0'))", "concat('8', lpad(cast(k % 10000 as string), 4, '0'))"),
    "name": ("3", "concat('Jordan ', " + pick("k % 15", LAST) + ")", "concat('Casey ', " + pick("k % 15", LAST) + ")"),
    "phone": ("4, 9", "concat('646', lpad(cast((k * 31 + 17) % 10000000 as string), 7, '0'))", "concat('(917) 555-', lpad(cast(k % 10000 as string), 4, '0'))"),
    "street": ("5", "concat(cast(200 + k % 700 as string), ' Broadway Ave')", "concat(cast(900 + k % 90 as string), ' Lake Rd.')"),
    "city": ("6", "'Hoboken'", "'Yonkers'"),
    "specialty": ("7", pick("(k + 1) % 4", SPECIALTY), pick("(k + 2) % 4", SPECIALTY)),
    "is_active": ("8", "0", "0"),
}
_HAS = "((j % 2 = 0 AND o % 9 = 0) OR (j % 2 = 1 AND o % 3 = 0))"


def _external(field: str, stored: str) -> str:
    if field not in _CHANGES:
        return stored
    rest, one, two = _CHANGES[field]
    return f"CASE WHEN k % 10 IN ({rest}) AND {_HAS} THEN CASE WHEN {_SEC} THEN {two} ELSE {one} END ELSE {stored} END"


EXTERNAL = {
    "k": "k", "npi": "npi", "ordinal": "o",
    "source_name": "CASE WHEN o % 41 = 0 THEN 'nppes_bulk' WHEN o % 43 = 0 THEN 'other_feed' WHEN o_orderpriority = '1-URGENT' THEN 'nppes' WHEN o_orderpriority = '2-HIGH' THEN 'cms' "
                   "WHEN o_orderpriority = '3-MEDIUM' THEN 'state_board' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'practice_site' ELSE 'clinic_site' END",
    "name": _external("name", "name"), "phone": f"CASE WHEN o % 11 = 0 THEN '' ELSE {_external('phone', 'phone')} END",
    **{f: _external(f, f) for f in ("street", "city", "state", "zip", "specialty", "is_active")},
}

INTAKE = {  # one row a customer: noise by k % 20
    "ordinal": "k",
    "npi": "CASE k % 20 WHEN 0 THEN concat(substr(npi, 1, 9), cast((cast(substr(npi, 10, 1) as int) + 1) % 10 as string)) WHEN 1 THEN substr(npi, 1, 9) WHEN 2 THEN concat(npi, '3') "
           "WHEN 3 THEN concat(substr(npi, 1, 3), '-', substr(npi, 4, 3), '-', substr(npi, 7)) WHEN 4 THEN concat(substr(npi, 1, 5), 'abcde') WHEN 5 THEN concat('3', substr(npi, 2)) "
           "WHEN 6 THEN NULL WHEN 10 THEN concat('  ', npi, ' ') ELSE npi END",
    "name": "CASE k % 20 WHEN 7 THEN '' WHEN 8 THEN 'Doc J' WHEN 9 THEN concat('Dr. ', name, ', PhD') WHEN 10 THEN concat('  ', replace(name, ' ', '   '), ' ') WHEN 11 THEN upper(name) "
            "WHEN 12 THEN concat('Hassan-', cast(k as string), ', Ahmed') ELSE name END",
    "error_type": pick("k % 20", quoted(["luhn_fail", "too_short", "too_long", "symbols", "letters", "bad_prefix", "null", "name_empty", "name_single", "titles", "spaces", "case", "reversed"] + ["clean"] * 7)),
    "expected_valid": "CASE WHEN k % 20 <= 8 THEN 'False' ELSE 'True' END",
}


def _exprs(table: dict) -> list[str]:
    return [f"{e} AS {n}" for n, e in table.items()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's rows over at least as many partitions as there are cores: a small file is one row group, thus one task."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: By folder of the given tables, a folder with the derived ones, written by prepare().
PREPARED: dict[str, str] = {}


def prepare(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Write the derived tables once, for the queries of this process to read in place of deriving them each time."""
    made = {"raw_directory": raw_directory(spark, sf_dir), "external": external(spark, sf_dir), "intake": intake(spark, sf_dir)}
    for name, df in made.items():
        df.write.parquet(f"{folder}/{name}")
    PREPARED[sf_dir] = folder


def _prepared(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    return spark.read.parquet(f"{PREPARED[sf_dir]}/{name}") if sf_dir in PREPARED else None


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*_exprs(KEYS)).selectExpr(*_exprs(DIRECTORY))


def raw_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    if (made := _prepared(spark, sf_dir, "raw_directory")) is not None:
        return made
    return customers(spark, sf_dir).withColumn("updated_at", F.expr(f"timestamp_ntz '{AS_OF}' - make_interval(0, 0, 0, age_days)")).drop("age_days")


def reported(orders: DataFrame, directory: DataFrame, *more: str) -> DataFrame:
    """Source rows: the raw directory's values with the changes that each order reports. more: columns of orders to keep."""
    return orders.selectExpr("o_custkey AS k", "o_orderkey AS o", "o_orderpriority", *more).join(directory, "k").selectExpr(*_exprs(EXTERNAL), *more)


def external(spark: SparkSession, sf_dir: str) -> DataFrame:
    if (made := _prepared(spark, sf_dir, "external")) is not None:
        return made
    return reported(table(spark, sf_dir, "orders"), customers(spark, sf_dir))


def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records with noise; every 33rd comes twice, the second time under a later ordinal."""
    if (made := _prepared(spark, sf_dir, "intake")) is not None:
        return made
    rows = customers(spark, sf_dir).selectExpr(*_exprs(INTAKE))
    return rows.unionByName(rows.filter("ordinal % 33 = 0").withColumn("ordinal", F.col("ordinal") + 10000000))


def _select(table: dict, source: str) -> str:
    return f"SELECT {', '.join(_exprs(table))} FROM {source}"


#: The same as common table expressions; k_ is free for other tables.
CTES = {
    "raw_dir": _select(DIRECTORY, f"({_select(KEYS, 'customer')})"),
    "ext": _select(EXTERNAL, "(SELECT o_custkey AS k, o_orderkey AS o, o_orderpriority FROM orders) JOIN raw_dir USING (k)"),
    "one_intake": _select(INTAKE, "raw_dir"),
    "intake": "SELECT * FROM one_intake UNION ALL SELECT ordinal + 10000000, npi, name, error_type, expected_valid FROM one_intake WHERE ordinal % 33 = 0",
}
