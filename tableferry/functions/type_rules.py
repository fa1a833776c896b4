"""Column types: translation between dialects, code tables and Spark types.

The tables below are fixed values.  They are looked up through literal maps, so
a translation is one expression inside the scan's code, with no join.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.functions.text import strip_space

# Base type of one dialect -> type of another.
MYSQL_TO_POSTGRESQL = {
    "BIGINT": "BIGINT", "BINARY": "BYTEA", "BIT": "BOOLEAN", "BLOB": "BYTEA", "BOOLEAN": "BOOLEAN",
    "CHAR": "CHAR", "DATE": "DATE", "DATETIME": "TIMESTAMP", "DECIMAL": "DECIMAL",
    "DOUBLE": "DOUBLE PRECISION", "ENUM": "VARCHAR", "FLOAT": "REAL", "INT": "INTEGER", "JSON": "JSONB",
    "LONGBLOB": "BYTEA", "LONGTEXT": "TEXT", "MEDIUMINT": "INTEGER", "MEDIUMTEXT": "TEXT",
    "NUMERIC": "NUMERIC", "SET": "VARCHAR", "SMALLINT": "SMALLINT", "TEXT": "TEXT", "TIME": "TIME",
    "TIMESTAMP": "TIMESTAMP", "TINYINT": "SMALLINT", "TINYTEXT": "TEXT", "VARBINARY": "BYTEA",
    "VARCHAR": "VARCHAR", "YEAR": "SMALLINT",
}
MYSQL_TO_SQLSERVER = {
    "BIGINT": "BIGINT", "BINARY": "VARBINARY", "BLOB": "VARBINARY(MAX)", "BOOLEAN": "BIT", "CHAR": "NCHAR",
    "DATE": "DATE", "DATETIME": "DATETIME2", "DECIMAL": "DECIMAL", "DOUBLE": "FLOAT", "FLOAT": "REAL",
    "INT": "INT", "JSON": "NVARCHAR(MAX)", "LONGTEXT": "NVARCHAR(MAX)", "SMALLINT": "SMALLINT",
    "TEXT": "NVARCHAR(MAX)", "TIME": "TIME", "TIMESTAMP": "DATETIME2", "TINYINT": "TINYINT",
    "VARCHAR": "NVARCHAR",
}
MYSQL_TO_ORACLE = {
    "BIGINT": "NUMBER(19,0)", "BINARY": "RAW", "BLOB": "BLOB", "BOOLEAN": "NUMBER(1,0)", "CHAR": "CHAR",
    "DATE": "DATE", "DATETIME": "TIMESTAMP", "DECIMAL": "NUMBER", "DOUBLE": "BINARY_DOUBLE",
    "FLOAT": "BINARY_FLOAT", "INT": "NUMBER(10,0)", "JSON": "CLOB", "LONGTEXT": "CLOB",
    "SMALLINT": "NUMBER(5,0)", "TEXT": "CLOB", "TIME": "TIMESTAMP", "TIMESTAMP": "TIMESTAMP",
    "TINYINT": "NUMBER(3,0)", "VARCHAR": "VARCHAR2",
}
POSTGRESQL_TO_MYSQL = {
    "BIGINT": "BIGINT", "BOOLEAN": "BOOLEAN", "BYTEA": "LONGBLOB", "CHAR": "CHAR", "CIDR": "VARCHAR(45)",
    "DATE": "DATE", "DECIMAL": "DECIMAL", "DOUBLE PRECISION": "DOUBLE", "INET": "VARCHAR(45)",
    "INTEGER": "INT", "JSON": "JSON", "JSONB": "JSON", "NUMERIC": "DECIMAL", "REAL": "FLOAT",
    "SMALLINT": "SMALLINT", "TEXT": "LONGTEXT", "TIME": "TIME", "TIMESTAMP": "DATETIME",
    "TIMESTAMPTZ": "DATETIME", "UUID": "CHAR(36)", "VARCHAR": "VARCHAR",
}
POSTGRESQL_TO_SQLSERVER = {
    "BIGINT": "BIGINT", "BOOLEAN": "BIT", "BYTEA": "VARBINARY(MAX)", "CHAR": "NCHAR", "DATE": "DATE",
    "DECIMAL": "DECIMAL", "DOUBLE PRECISION": "FLOAT", "INTEGER": "INT", "JSON": "NVARCHAR(MAX)",
    "JSONB": "NVARCHAR(MAX)", "REAL": "REAL", "SMALLINT": "SMALLINT", "TEXT": "NVARCHAR(MAX)",
    "TIME": "TIME", "TIMESTAMP": "DATETIME2", "UUID": "UNIQUEIDENTIFIER", "VARCHAR": "NVARCHAR",
}
DIALECT_RULES = {
    ("mysql", "oracle"): MYSQL_TO_ORACLE,
    ("mysql", "postgresql"): MYSQL_TO_POSTGRESQL,
    ("mysql", "sqlserver"): MYSQL_TO_SQLSERVER,
    ("postgresql", "mysql"): POSTGRESQL_TO_MYSQL,
    ("postgresql", "sqlserver"): POSTGRESQL_TO_SQLSERVER,
}

# Target types that keep the source's (length) or (precision, scale).
PARAMETER_TYPES = r"^(CHAR|DECIMAL|FLOAT|NCHAR|NUMBER|NUMERIC|NVARCHAR|VARCHAR)"

# What a base type without a rule becomes.  Families are tried in
# this order and match anywhere in the name; "default" is for other targets.
GENERIC_RULES = [
    ("VARCHAR|CHAR|TEXT|STRING", {"default": "VARCHAR(255)", "mysql": "VARCHAR(255)", "oracle": "VARCHAR2(255)",
                                  "postgresql": "VARCHAR", "sqlserver": "NVARCHAR(255)"}),
    ("INT|INTEGER|NUMBER", {"default": "INTEGER", "oracle": "NUMBER(10,0)"}),
    ("DECIMAL|NUMERIC|FLOAT|DOUBLE", {"default": "DECIMAL", "oracle": "NUMBER"}),
    ("DATE|TIME|TIMESTAMP|DATETIME", {"default": "TIMESTAMP", "mysql": "DATETIME", "oracle": "TIMESTAMP",
                                      "postgresql": "TIMESTAMP", "sqlserver": "DATETIME2"}),
    ("BOOLEAN|BOOL|BIT", {"default": "BOOLEAN", "mysql": "BOOLEAN", "oracle": "NUMBER(1,0)",
                          "postgresql": "BOOLEAN", "sqlserver": "BIT"}),
    ("BINARY|BLOB|BYTEA", {"default": "BLOB", "mysql": "LONGBLOB", "oracle": "BLOB", "postgresql": "BYTEA",
                           "sqlserver": "VARBINARY(MAX)"}),
]
GENERIC_FALLBACK = "VARCHAR(255)"

# Names each reader gives to the types it meets.
MYSQL_NAMES = {
    "bigint": "BIGINT", "binary": "BINARY", "bit": "BIT", "blob": "BLOB", "bool": "BOOLEAN",
    "boolean": "BOOLEAN", "char": "CHAR", "date": "DATE", "datetime": "DATETIME", "decimal": "DECIMAL",
    "double": "DOUBLE", "enum": "ENUM", "float": "FLOAT", "int": "INTEGER", "json": "JSON",
    "longblob": "LONGBLOB", "longtext": "LONGTEXT", "mediumblob": "MEDIUMBLOB", "mediumint": "MEDIUMINT",
    "mediumtext": "MEDIUMTEXT", "numeric": "NUMERIC", "set": "SET", "smallint": "SMALLINT", "text": "TEXT",
    "time": "TIME", "timestamp": "TIMESTAMP", "tinyblob": "TINYBLOB", "tinyint": "TINYINT",
    "tinytext": "TINYTEXT", "varbinary": "VARBINARY", "varchar": "VARCHAR", "year": "YEAR",
}
FIREBIRD_NAMES = {
    "BIGINT": "BIGINT", "BLOB": "BLOB", "BOOLEAN": "BOOLEAN", "CHAR": "CHAR", "DATE": "DATE",
    "DECIMAL": "DECIMAL", "DOUBLE": "DOUBLE PRECISION", "FLOAT": "FLOAT", "INTEGER": "INTEGER",
    "NUMERIC": "NUMERIC", "SMALLINT": "SMALLINT", "TEXT": "BLOB SUB_TYPE TEXT", "TIME": "TIME",
    "TIMESTAMP": "TIMESTAMP", "VARCHAR": "VARCHAR",
}
PARADOX_NAMES = {
    "#": "INTEGER", "+": "INTEGER", "@": "TIMESTAMP", "A": "VARCHAR", "B": "BLOB", "C": "DECIMAL",
    "CHAR": "CHAR", "D": "DATE", "DATE": "DATE", "DECIMAL": "DECIMAL", "DOUBLE": "DOUBLE", "F": "BLOB",
    "FLOAT": "FLOAT", "G": "BLOB", "I": "INTEGER", "INTEGER": "INTEGER", "L": "BOOLEAN",
    "LONGVARCHAR": "TEXT", "M": "TEXT", "N": "DECIMAL", "NUMERIC": "NUMERIC", "O": "BLOB", "REAL": "REAL",
    "S": "SMALLINT", "SMALLINT": "SMALLINT", "T": "TIME", "TIME": "TIME", "TIMESTAMP": "TIMESTAMP",
    "VARCHAR": "VARCHAR", "Y": "DECIMAL",
}
PARADOX_TO_FIREBIRD = {
    "AUTOINCREMENT": "INTEGER", "BCD": "NUMERIC(18,4)", "BINARY": "BLOB SUB_TYPE 0", "DATE": "DATE",
    "FORMATTED MEMO": "BLOB SUB_TYPE 1", "GRAPHIC": "BLOB SUB_TYPE 0", "LOGICAL": "SMALLINT",
    "MEMO": "BLOB SUB_TYPE 1", "MONEY": "NUMERIC(15,4)", "OLE": "BLOB SUB_TYPE 0", "TIME": "TIME",
    "TIMESTAMP": "TIMESTAMP",
}
FIREBIRD_TEXT_LIMIT = 32765
LONG_VARCHAR = 8191

# Firebird field codes of the first reader.  Codes in FIXED_POINT
# become NUMERIC or DECIMAL by sub-type 1 or 2.
FIREBIRD_CODES = {
    7: "SMALLINT", 8: "INTEGER", 9: "QUAD", 10: "FLOAT", 11: "DOUBLE PRECISION", 12: "DATE", 13: "TIME",
    14: "CHAR", 15: "VARCHAR", 16: "BIGINT", 17: "CHAR", 18: "DOUBLE PRECISION", 19: "ARRAY", 20: "QUAD",
    23: "BOOLEAN", 24: "DECFLOAT", 25: "DECFLOAT", 26: "BIGINT", 27: "DOUBLE PRECISION", 35: "TIMESTAMP",
    37: "VARCHAR", 40: "CHAR", 45: "BLOB", 261: "BLOB", 262: "ARRAY", 263: "QUAD", 264: "EXTENDED",
    265: "TIMESTAMP WITH TIME ZONE", 266: "TIME WITH TIME ZONE", 267: "INT128",
}
FIXED_POINT = [7, 8, 16, 26, 267]
SUB_TYPES = {1: "NUMERIC", 2: "DECIMAL"}

# Firebird field codes of the second reader.  Codes in SCALED
# become NUMERIC when the scale is negative, with this default precision; codes
# in SIZED carry their length; sub-types name the kinds of BLOB.
FIREBIRD_CODES_V2 = {
    7: "SMALLINT", 8: "INTEGER", 9: "QUAD", 10: "FLOAT", 11: "DOUBLE PRECISION", 12: "DATE", 13: "TIME",
    14: "CHAR", 16: "BIGINT", 17: "BOOLEAN", 18: "DECFLOAT(16)", 19: "DECFLOAT(34)", 20: "INT128",
    21: "TIME WITH TIME ZONE", 22: "TIMESTAMP WITH TIME ZONE", 23: "BOOLEAN", 24: "DECFLOAT(16)",
    25: "DECFLOAT(34)", 26: "INT128", 27: "DOUBLE PRECISION", 28: "TIME WITH TIME ZONE",
    29: "TIMESTAMP WITH TIME ZONE", 30: "INT128", 35: "TIMESTAMP", 37: "VARCHAR", 40: "CSTRING",
    45: "BLOB_ID", 262: "ARRAY", 263: "QUAD", 264: "EXTENDED", 265: "TIMESTAMP WITH TIME ZONE",
    266: "EXTENDED", 267: "INT128",
}
SCALED_V2 = {7: 15, 8: 18, 16: 18}
SIZED_V2 = [14, 37, 40]
BLOB_KINDS = {
    0: "BLOB BINARY", 1: "BLOB TEXT", 2: "BLOB BLR", 3: "BLOB ACL", 4: "BLOB RANGES", 5: "BLOB SUMMARY",
    6: "BLOB FORMAT", 7: "BLOB TRANSACTION_DESCRIPTION", 8: "BLOB EXTERNAL_FILE_DESCRIPTION",
}
BLOB_CODE = 261
# Unknown codes that still fall in a known range.
CODE_RANGES_V2 = [(15, 15, "CHAR"), (36, 36, "TIMESTAMP"), (38, 39, "VARCHAR")]

# SQLite affinity by fragments of the type name, in order.
SQLITE_SCHEMA_FRAGMENTS = [
    ("INT", "INTEGER"), ("TEXT|CHAR|VARCHAR", "TEXT"), ("REAL|FLOAT|DOUBLE", "REAL"), ("BLOB", "BLOB"),
    ("NUMERIC|DECIMAL", "NUMERIC"),
]
SQLITE_MAPPED_FRAGMENTS = [
    ("INT", "INTEGER"), ("CHAR|TEXT", "TEXT"), ("REAL|FLOA|DOUB", "REAL"), ("BLOB", "BLOB"),
    ("NUMERIC|DECIMAL", "NUMERIC"), ("DATE", "DATE"), ("TIME", "DATETIME"), ("BOOL", "BOOLEAN"),
]


def lookup(table: dict, key: Column) -> Column:
    """The table's value for a key, NULL when it has none."""
    entries = F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())])
    return F.try_element_at(entries, key)


def by_fragment(name: Column, fragments: list[tuple[str, str]], otherwise: Column) -> Column:
    """The value of the first fragment found anywhere in the name."""
    tests = [(name.rlike(pattern), F.lit(value)) for pattern, value in fragments]
    found = F.when(*tests[0])
    for test, value in tests[1:]:
        found = found.when(test, value)
    return found.otherwise(otherwise)


def base_type(t: Column) -> Column:
    """The upper-case name before any parameters."""
    upper = F.upper(t)
    base = strip_space(F.split_part(upper, F.lit("("), F.lit(1)))
    return F.when(base == "", upper).otherwise(base)


def type_parameters(t: Column) -> Column:
    """``(255)`` or ``(10,2)`` of a type, empty when it has none."""
    return F.regexp_extract(F.upper(t), r"(\([^)]+\))", 1)


def map_type(t: Column, source_db: str, target_db: str) -> Column:
    """Translate a type; parameters are kept where the target type takes them."""
    source = {"postgres": "postgresql"}.get(source_db.lower(), source_db.lower())
    generic = generic_type(base_type(t), target_db)
    rules = DIALECT_RULES.get((source, target_db.lower()))
    if rules is None:
        return generic
    mapped = lookup(rules, base_type(t))
    with_parameters = F.when(mapped.rlike(PARAMETER_TYPES), F.concat(mapped, type_parameters(t))).otherwise(mapped)
    return F.coalesce(with_parameters, generic)


def generic_type(base: Column, target_db: str) -> Column:
    """Translate a base type that no rule names."""
    target = target_db.lower()
    fragments = [(pattern, values.get(target, values["default"])) for pattern, values in GENERIC_RULES]
    return by_fragment(base, fragments, F.lit(GENERIC_FALLBACK))


def mysql_type_name(t: Column) -> Column:
    return F.coalesce(lookup(MYSQL_NAMES, F.lower(base_type(t))), F.upper(t))


def firebird_type_name(t: Column) -> Column:
    return F.coalesce(lookup(FIREBIRD_NAMES, base_type(t)), F.upper(t))


def paradox_type_name(t: Column) -> Column:
    return F.coalesce(lookup(PARADOX_NAMES, F.upper(t)), F.lit("VARCHAR"))


def paradox_to_firebird(t: Column, length: Column, precision: Column) -> Column:
    """Long Paradox type names to Firebird, with length cap and precision."""
    name = F.upper(t)
    sized = F.coalesce(length, F.lit(0)) != 0
    precise = F.coalesce(precision, F.lit(0)) != 0
    capped = F.concat(F.lit("VARCHAR("), F.least(length, F.lit(FIREBIRD_TEXT_LIMIT)), F.lit(")"))
    return (
        F.when(name == "ALPHA", F.when(sized, capped).otherwise("VARCHAR(255)"))
        .when(name == "NUMBER", F.when(precise, F.concat(F.lit("NUMERIC(18,"), precision, F.lit(")"))).otherwise("NUMERIC(18,4)"))
        .when(name == "BYTES", F.concat(F.lit("CHAR("), F.when(sized, length).otherwise(255), F.lit(")")))
        .otherwise(F.coalesce(lookup(PARADOX_TO_FIREBIRD, name), F.lit("VARCHAR(255)")))
    )


def adapt_long_varchar(t: Column, original: Column) -> Column:
    """Over-long VARCHAR that came from ALPHA becomes a text BLOB."""
    size = F.regexp_extract(t, r"VARCHAR\((\d+)\)", 1).try_cast("bigint")
    return F.when((original == "ALPHA") & (size > LONG_VARCHAR), "BLOB SUB_TYPE 1").otherwise(t)


def _numeric_text(name: str, precision: Column, scale: Column) -> Column:
    return F.concat(F.lit(f"{name}("), precision, F.lit(","), scale, F.lit(")"))


def firebird_type(code: Column, sub_type: Column, precision: Column, scale: Column) -> Column:
    """Type name of a Firebird field code (first reader)."""
    precise = F.coalesce(precision, F.lit(0)) != 0
    return (
        F.when((code == 26) & precise & (scale >= 0), _numeric_text("NUMERIC", precision, scale))
        .when(code.isin(FIXED_POINT) & sub_type.isin(list(SUB_TYPES)), lookup(SUB_TYPES, sub_type))
        .when((code == BLOB_CODE) & (sub_type == 1), "BLOB SUB_TYPE TEXT")
        .otherwise(F.coalesce(lookup(FIREBIRD_CODES, code), F.lit("VARCHAR")))
    )


def firebird_type_text(code: Column, sub_type: Column, length: Column, precision: Column, scale: Column) -> Column:
    """Full type text of a Firebird field code, with length or precision."""
    precise = (F.coalesce(precision, F.lit(0)) != 0) & scale.isNotNull()
    sized = F.coalesce(length, F.lit(0)) != 0
    size = F.when(sized, length).otherwise(1)
    plain = firebird_type(code, sub_type, precision, scale)
    whole = lookup(FIREBIRD_CODES, code)
    return (
        F.when(code.isin(14, 37), F.concat(whole, F.lit("("), size, F.lit(")")))
        .when(code == 26, F.when(precise, _numeric_text("NUMERIC", precision, F.abs(scale))).otherwise("NUMERIC"))
        .when(
            code.isin(FIXED_POINT) & precise & sub_type.isin(list(SUB_TYPES)),
            F.concat(lookup(SUB_TYPES, sub_type), F.lit("("), precision, F.lit(","), F.abs(scale), F.lit(")")),
        )
        .when(code.isin(FIXED_POINT), whole)
        .when((code == BLOB_CODE) & ~sub_type.isin(0, 1), F.concat(F.lit("BLOB SUB_TYPE "), sub_type))
        .when(code == 24, "DECFLOAT(16)")
        .when(code == 25, "DECFLOAT(34)")
        .when(plain.isin("CHAR", "VARCHAR") & sized, F.concat(plain, F.lit("("), length, F.lit(")")))
        .otherwise(plain)
    )


def firebird_type_v2(code: Column, sub_type: Column, length: Column, scale: Column, precision: Column) -> Column:
    """Type text of a Firebird field code (second reader)."""
    sized = F.concat(F.lit("("), F.when(F.coalesce(length, F.lit(0)) != 0, length).otherwise(1), F.lit(")"))
    precise = F.when(F.coalesce(precision, F.lit(0)) != 0, precision).otherwise(lookup(SCALED_V2, code))
    named = lookup(FIREBIRD_CODES_V2, code)
    unknown = F.concat(
        F.lit("UNKNOWN_TYPE_"), code, F.when(F.coalesce(sub_type, F.lit(0)) != 0, F.concat(F.lit("_SUB"), sub_type)).otherwise("")
    )
    for low, high, name in reversed(CODE_RANGES_V2):
        shown = F.lit(name) if name == "TIMESTAMP" else F.concat(F.lit(name), sized)
        unknown = F.when(code.between(low, high), shown).otherwise(unknown)
    return (
        F.when(code.isin(list(SCALED_V2)) & (scale < 0), _numeric_text("NUMERIC", precise, F.abs(scale)))
        .when(code.isin(SIZED_V2), F.concat(named, sized))
        .when(code == BLOB_CODE, F.coalesce(lookup(BLOB_KINDS, sub_type), F.concat(F.lit("BLOB("), sub_type, F.lit(")"))))
        .otherwise(F.coalesce(named, unknown))
    )


def sqlite_schema_type(t: Column) -> Column:
    """Affinity as the SQLite schema reader names it; unknown names stay."""
    return by_fragment(F.upper(t), SQLITE_SCHEMA_FRAGMENTS, F.upper(t))


def sqlite_mapped_type(t: Column) -> Column:
    """Affinity as the SQLite type map names it; unknown names are TEXT."""
    return by_fragment(F.upper(t), SQLITE_MAPPED_FRAGMENTS, F.lit("TEXT"))


def clean_default(d: Column) -> Column:
    """Default text without its leading keyword."""
    return strip_space(F.regexp_replace(strip_space(d), "^DEFAULT ", ""))


# The Spark type that holds each dialect type.
SPARK_TYPES = {
    "BIGINT": "bigint", "BINARY": "binary", "BIT": "boolean", "BLOB": "binary", "BOOL": "boolean",
    "BOOLEAN": "boolean", "BYTEA": "binary", "CHAR": "string", "CLOB": "string", "DATE": "date",
    "DATETIME": "timestamp_ntz", "DECFLOAT": "double", "DOUBLE": "double", "DOUBLE PRECISION": "double",
    "FLOAT": "float", "INT": "int", "INT128": "decimal(38,0)", "INTEGER": "int", "LOGICAL": "boolean",
    "LONGBLOB": "binary", "LONGTEXT": "string", "MEDIUMINT": "int", "NVARCHAR": "string", "RAW": "binary",
    "REAL": "double", "SMALLINT": "smallint", "STRING": "string", "TEXT": "string", "TIME": "string",
    "TIMESTAMP": "timestamp_ntz", "TINYINT": "tinyint", "VARBINARY": "binary", "VARCHAR": "string",
    "VARCHAR2": "string", "YEAR": "int",
}
EXACT_TYPES = ["BCD", "CURRENCY", "DECIMAL", "MONEY", "NUMBER", "NUMERIC"]


def spark_type(name: str) -> str:
    """The Spark type that holds a dialect type; unknown names become text.

    An exact type without digits gets 28 before the point and 10 after it; one
    of more digits than Spark's decimals have stays text, so none is lost.
    """
    upper = name.upper().strip()
    if upper in ("BLOB SUB_TYPE TEXT", "BLOB SUB_TYPE 1", "BLOB TEXT"):
        return "string"
    base, _, rest = upper.partition("(")
    base = base.strip()
    if base in EXACT_TYPES:
        digits = [int(d) for d in re.findall(r"\d+", rest)]
        precision, scale = (digits + [0])[:2] if digits else (38, 10)
        return f"decimal({precision},{scale})" if scale <= precision <= 38 else "string"
    return SPARK_TYPES.get(base) or ("binary" if base.startswith("BLOB") else "string")


# The dialect-neutral name of each Spark type in a schema catalog.
CATALOG_NAMES = {
    T.BinaryType: "BLOB", T.BooleanType: "BOOLEAN", T.ByteType: "TINYINT", T.DateType: "DATE",
    T.DoubleType: "DOUBLE", T.FloatType: "FLOAT", T.IntegerType: "INTEGER", T.LongType: "BIGINT",
    T.ShortType: "SMALLINT", T.StringType: "VARCHAR", T.TimestampNTZType: "TIMESTAMP",
    T.TimestampType: "TIMESTAMPTZ",
}


def catalog_name(dtype: T.DataType) -> str:
    if isinstance(dtype, T.DecimalType):
        return f"DECIMAL({dtype.precision},{dtype.scale})"
    return CATALOG_NAMES.get(type(dtype), dtype.typeName().upper())
