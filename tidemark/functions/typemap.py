"""Source column metadata to target types, as expressions over a metadata table.

A whole catalogue of columns is mapped in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The type names the target warehouse uses.
WHOLE = "NUMBER(38,0)"
STAR_NUMBER = "NUMBER(38,18)"
LONG_TEXT = "VARCHAR(16777216)"
LONG_TEXT_SIZE = 16777216
MAX_PRECISION = 38

# MySQL type families and what they become.
MYSQL_WHOLE = ("tinyint", "smallint", "mediumint", "int", "integer", "bigint", "year", "bit")
MYSQL_BLOB = ("blob", "tinyblob", "mediumblob", "longblob", "binary", "varbinary")
MYSQL_BLOB_MODES = {"binary": "BINARY", "text": LONG_TEXT, "skip": "VARCHAR"}
MYSQL_FIXED = {
    "float": "FLOAT",
    "double": "FLOAT",
    "real": "FLOAT",
    "datetime": "TIMESTAMP_NTZ",
    "timestamp": "TIMESTAMP_TZ",
    "date": "DATE",
    "time": "TIME",
    "json": "VARIANT",
    "enum": "VARCHAR(512)",
    "set": "VARCHAR(512)",
    "text": LONG_TEXT,
    "tinytext": LONG_TEXT,
    "mediumtext": LONG_TEXT,
    "longtext": LONG_TEXT,
}

# Teradata type names matched whole, and by how they begin.
TERADATA_WHOLE = {
    "BYTEINT": WHOLE,
    "SMALLINT": WHOLE,
    "INTEGER": WHOLE,
    "BIGINT": WHOLE,
    "DECIMAL": WHOLE,
    "NUMERIC": WHOLE,
    "NUMBER": WHOLE,
    "FLOAT": "FLOAT",
    "REAL": "FLOAT",
    "DOUBLE PRECISION": "FLOAT",
    "DATE": "DATE",
    "INTDATE": "DATE",
    "TIME": "TIME",
    "CHAR": "VARCHAR(255)",
    "CHARACTER": "VARCHAR(255)",
    "VARCHAR": LONG_TEXT,
    "XML": LONG_TEXT,
}
TERADATA_PREFIX = (
    ("TIME(", "TIME"),
    ("INTERVAL", "VARCHAR(128)"),
    ("PERIOD", "VARCHAR(128)"),
    ("CLOB", LONG_TEXT),
    ("BLOB", "BINARY"),
    ("BYTE", "BINARY"),
    ("VARBYTE", "BINARY"),
    ("JSON", "VARIANT"),
)

# Dictionary type codes. Sized codes carry a length, scaled codes a
# fraction, interval codes a leading and sometimes a trailing field.
SIZED_CODES = {"BF": "BYTE", "BV": "VARBYTE", "CF": "CHAR", "CV": "VARCHAR", "BO": "BLOB", "CO": "CLOB", "JN": "JSON"}
PLAIN_CODES = {
    "DA": "DATE",
    "F": "FLOAT",
    "I1": "BYTEINT",
    "I2": "SMALLINT",
    "I8": "BIGINT",
    "I": "INTEGER",
    "PD": "PERIOD(DATE)",
    "XM": "XML",
}
FRACTION_CODES = {
    "AT": "TIME({f})",
    "TS": "TIMESTAMP({f})",
    "TZ": "TIME({f}) WITH TIME ZONE",
    "SZ": "TIMESTAMP({f}) WITH TIME ZONE",
    "PS": "PERIOD(TIMESTAMP({f}))",
    "PT": "PERIOD(TIME({f}))",
    "PM": "PERIOD(TIMESTAMP({f}) WITH TIME ZONE)",
    "PZ": "PERIOD(TIME({f}) WITH TIME ZONE)",
}
INTERVAL_CODES = {
    "YR": ("YEAR", None),
    "YM": ("YEAR", "MONTH"),
    "MO": ("MONTH", None),
    "DY": ("DAY", None),
    "DH": ("DAY", "HOUR"),
    "DM": ("DAY", "MINUTE"),
    "DS": ("DAY", "SECOND"),
    "HR": ("HOUR", None),
    "HM": ("HOUR", "MINUTE"),
    "HS": ("HOUR", "SECOND"),
    "MI": ("MINUTE", None),
    "MS": ("MINUTE", "SECOND"),
    "SC": ("SECOND", None),
}
CHAR_CODES = ("CF", "CV")
CHAR_LIMIT = 64000
UNSET = -128

# The legacy program's extra codes and its index kinds.
LEGACY_PLAIN_CODES = {"DA": "INTDATE", "++": "TD_ANYTYPE", "VA": "TD_VALIST"}
LEGACY_CHARSETS = {
    1: " CHARACTER SET LATIN",
    2: " CHARACTER SET UNICODE",
    3: " CHARACTER SET KANJISJIS",
    4: " CHARACTER SET GRAPHIC",
    5: " CHARACTER SET KANJI1",
}
INDEX_KINDS = {
    "P": "Nonpartitioned primary index",
    "Q": "Partitioned primary index",
    "S": "Secondary index",
    "J": "n index",
    "N": "Hash index",
    "K": "Primary key",
    "U": "Unique constraint",
    "V": "Value-ordered secondary index",
    "H": "Hash-ordered ALL covering secondary index",
    "O": "Valued-ordered ALL covering secondary index",
    "I": "dering column of a composite secondary index",
    "G": "Geospatial non-unique secondary index.",
    "M": "Multi column statistics",
    "D": "Derived column partition statistics",
    "1": "field1 column of a join or hash index",
    "2": " field2 column of a join or hash index",
}


def _lookup(key: Column, table: dict) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def _number(precision: Column, scale: Column) -> Column:
    return F.when(precision > MAX_PRECISION, "VARCHAR").otherwise(
        F.concat(F.lit("NUMBER("), precision.cast("string"), F.lit(","), scale.cast("string"), F.lit(")"))
    )


def mysql_type(
    data_type: Column,
    column_type: Column,
    precision: Column,
    scale: Column,
    length: Column,
    blob_mode: Column | str = "binary",
) -> Column:
    kind = F.lower(F.coalesce(data_type, F.lit("")))
    mode = F.lit(blob_mode) if isinstance(blob_mode, str) else blob_mode
    flag = (kind == "tinyint") & F.contains(F.lower(F.coalesce(column_type, F.lit(""))), F.lit("tinyint(1)"))
    size = F.when(length > 0, length.cast("long")).otherwise(F.lit(LONG_TEXT_SIZE).cast("long"))
    return (
        F.when(flag, "BOOLEAN")
        .when(kind.isin(*MYSQL_WHOLE), WHOLE)
        .when(
            kind.isin("decimal", "numeric"),
            _number(F.coalesce(precision, F.lit(MAX_PRECISION)).cast("int"), F.coalesce(scale, F.lit(0)).cast("int")),
        )
        .when(kind.isin(*MYSQL_BLOB), F.coalesce(_lookup(mode, MYSQL_BLOB_MODES), F.lit("BINARY")))
        .when(kind.isin("char", "varchar"), F.concat(F.lit("VARCHAR("), size.cast("string"), F.lit(")")))
        .otherwise(F.coalesce(_lookup(kind, MYSQL_FIXED), F.lit(LONG_TEXT)))
    )


def teradata_type(type_text: Column) -> Column:
    text = F.upper(F.trim(F.coalesce(type_text, F.lit(""))))
    inside = F.regexp_extract(text, r"^(?:DECIMAL|NUMERIC|NUMBER)\(([^)]+)\)", 1)
    parts = F.split(inside, ",")
    precision = F.coalesce(F.trim(F.get(parts, F.lit(0))).try_cast("int"), F.lit(MAX_PRECISION))
    scale = F.coalesce(F.trim(F.get(parts, F.lit(1))).try_cast("int"), F.lit(0))
    fixed_len = F.regexp_extract(text, r"^(?:CHAR|CHARACTER)\((\d+)\)", 1)
    var_len = F.regexp_extract(text, r"^VARCHAR\((\d+)\)", 1)
    by_prefix = F.lit(LONG_TEXT)
    for prefix, target in reversed(TERADATA_PREFIX):
        by_prefix = F.when(F.startswith(text, F.lit(prefix)), target).otherwise(by_prefix)
    return (
        F.when(F.contains(inside, F.lit("*")), STAR_NUMBER)
        .when(inside != "", _number(precision, scale))
        .when(
            F.startswith(text, F.lit("TIMESTAMP")),
            F.when(F.contains(text, F.lit("WITH TIME ZONE")), "TIMESTAMP_TZ").otherwise("TIMESTAMP_NTZ"),
        )
        .when(fixed_len != "", F.concat(F.lit("VARCHAR("), fixed_len.cast("bigint").cast("string"), F.lit(")")))
        .when(
            var_len != "",
            F.concat(
                F.lit("VARCHAR("),
                F.least(var_len.cast("bigint"), F.lit(LONG_TEXT_SIZE).cast("bigint")).cast("string"),
                F.lit(")"),
            ),
        )
        .otherwise(F.coalesce(_lookup(text, TERADATA_WHOLE), by_prefix))
    )


def _interval(lead: str, trail: str | None, code: str, digits: bool) -> str:
    """An interval's text; with ``digits`` its fields carry their sizes."""
    first = "({d},{f})" if digits and code == "SC" else "({d})" if digits else ""
    last = f" TO {trail}" if trail else ""
    return f"INTERVAL {lead}{first}{last}" + ("({f})" if digits and trail == "SECOND" else "")


def _templates(digits: bool) -> dict[str, str]:
    """Text per type code, with ``{l}`` for the length, ``{d}`` for the digits, ``{f}``
    for the fraction and ``{n}`` for the inside of a free-scale number."""
    spans = {code: _interval(lead, trail, code, digits) for code, (lead, trail) in INTERVAL_CODES.items()}
    sized = {code: f"{name}({{l}})" for code, name in SIZED_CODES.items()}
    return {**sized, **PLAIN_CODES, **FRACTION_CODES, **spans, "D": "DECIMAL({d},{f})", "N": "NUMBER({n})"}


_ABSENT = "\0"


def _filled(template: Column, length: Column, digits: Column, fraction: Column) -> Column:
    whole = F.when(digits == UNSET, "*").otherwise(digits.cast("string"))
    tail = F.when(fraction.isin(0, UNSET), "").otherwise(F.concat(F.lit(","), fraction.cast("string")))
    values = {"{l}": length.cast("string"), "{d}": digits.cast("string"), "{f}": fraction.cast("string")}
    values["{n}"] = F.concat(whole, tail)
    text = template
    for mark, value in values.items():
        text = F.replace(text, F.lit(mark), F.coalesce(value, F.lit(_ABSENT)))
    return F.when(~F.contains(text, F.lit(_ABSENT)), text)


def dictionary_type(code: Column, length: Column, digits: Column, fraction: Column) -> Column:
    """Dictionary type code to type text."""
    key = F.rtrim(code)
    size = F.when(key.isin(*CHAR_CODES), F.least(length, F.lit(CHAR_LIMIT))).otherwise(length)
    template = F.coalesce(_lookup(key, _templates(digits=False)), F.lit(LONG_TEXT))
    return _filled(template, size, digits, fraction)


def legacy_dictionary_type(
    code: Column, length: Column, digits: Column, fraction: Column, udt_name: Column
) -> Column:
    """The older rules: doubled character lengths, digits inside intervals, unknowns named."""
    key = F.rtrim(code)
    size = F.when(key.isin(*CHAR_CODES), F.least(length * 2, F.lit(CHAR_LIMIT))).otherwise(length)
    template = _lookup(key, {**_templates(digits=True), **LEGACY_PLAIN_CODES})
    return F.coalesce(
        _filled(template, size, digits, fraction),
        F.when(key == "UT", udt_name),
        F.when(key.isin("A1", "AN"), F.concat(F.lit("SYSUDTLIB."), udt_name)),
        F.concat(F.lit("<Unknown> "), code),
    )


def legacy_charset(code: Column, char_type: Column) -> Column:
    named = F.coalesce(_lookup(char_type.cast("int"), LEGACY_CHARSETS), F.lit(""))
    return F.when(F.rtrim(code).isin("CV", "CF", "CO"), named).otherwise("")


def index_kind(code: Column) -> Column:
    return _lookup(code, INDEX_KINDS)


# Target type names and the Spark types that hold them.
_SPARK_TYPES = {
    "BOOLEAN": "boolean",
    "FLOAT": "double",
    "TIMESTAMP_NTZ": "timestamp_ntz",
    "TIMESTAMP_TZ": "timestamp",
    "DATE": "date",
    "BINARY": "binary",
}


def spark_type(target_type: str) -> str:
    """Spark DDL type for one target type name. Whole numbers are held as ``bigint``;
    times, JSON and text as ``string``."""
    if target_type == WHOLE:
        return "bigint"
    if target_type.startswith("NUMBER("):
        return "decimal" + target_type[len("NUMBER"):]
    return _SPARK_TYPES.get(target_type, "string")


def spark_type_text(target_type: Column) -> Column:
    """The same rule over a metadata table."""
    return (
        F.when(target_type == WHOLE, "bigint")
        .when(
            F.startswith(target_type, F.lit("NUMBER(")),
            F.replace(target_type, F.lit("NUMBER"), F.lit("decimal")),
        )
        .otherwise(F.coalesce(_lookup(target_type, _SPARK_TYPES), F.lit("string")))
    )
