"""Metadata and document filters, compiled to Catalyst expressions.

where: {field: condition}, all of which must hold. A condition is a value (equality), a list or {"$in": [...]} (any of), or
bounds {"$gte", "$gt", "$lte", "$lt"} that one and the same value must meet; "$in" beside bounds means either. A field that
holds a list matches if one of its values does. An unknown operator matches nothing. Numbers and booleans are equal as
Python has them (True == 1 == 1.0); text only equals text.

where_document: {"$contains": text}, {"$not_contains": text}, {"$and": [...]}, {"$or": [...]}; several keys must all hold.
An unknown operator or an operand of a wrong type makes its whole object false. Empty documents never match.

Over typed columns a filter becomes plain comparisons, which reach the Parquet scan; over VARIANT it's evaluated after it.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidRecord

BOUNDS = {"$gte": "__ge__", "$gt": "__gt__", "$lte": "__le__", "$lt": "__lt__"}
NUMBERS = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)"
EXACT = 2**53


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def some(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


class Typed:
    """A field that is a column of a known type."""

    def __init__(self, column: Column, kind: T.DataType):
        self.column, self.kind = column, kind

    def test(self, value_test) -> Column:
        if isinstance(self.kind, T.ArrayType):
            return F.exists(self.column, lambda x: F.coalesce(value_test(x, self.kind.elementType), F.lit(False)))
        return value_test(self.column, self.kind)

    @staticmethod
    def comparable(kind: T.DataType, value) -> bool:
        if isinstance(value, str):
            return isinstance(kind, T.StringType)
        return isinstance(value, bool | int | float) and isinstance(kind, T.NumericType | T.BooleanType)

    @staticmethod
    def pair(x: Column, kind: T.DataType, value) -> tuple[Column, Column]:
        if isinstance(kind, T.BooleanType) and not isinstance(value, bool):
            return x.cast("double"), F.lit(float(value))
        if isinstance(value, bool) and not isinstance(kind, T.BooleanType):
            value = int(value)
        return x, F.lit(value)

    def equals(self, x: Column, kind: T.DataType, value) -> Column:
        if value is None:
            return x.isNull()
        if not self.comparable(kind, value):
            return F.lit(False)
        a, b = self.pair(x, kind, value)
        return a == b

    def bound(self, x: Column, kind: T.DataType, op: str, value) -> Column:
        if not self.comparable(kind, value):
            return F.lit(False)
        a, b = self.pair(x, kind, value)
        return getattr(a, BOUNDS[op])(b)


class Dynamic:
    """A field of a VARIANT object."""

    def __init__(self, metadata: Column, name: str):
        # Paths have no escapes: a name with both kinds of quotes is looked up in a map of the whole object.
        quote = "'" if "'" not in name else '"'
        if quote in name:
            self.value = F.try_element_at(F.try_variant_get(metadata, "$", "map<string,variant>"), F.lit(name))
        else:
            self.value = F.try_variant_get(metadata, f"$[{quote}{name}{quote}]", "variant")
        self.listed = F.try_variant_get(self.value, "$", "array<variant>")

    def test(self, value_test) -> Column:
        values = F.when(F.schema_of_variant(self.value).startswith("ARRAY"), self.listed).otherwise(F.array(self.value))
        return self.value.isNotNull() & F.exists(values, lambda x: F.coalesce(value_test(x, None), F.lit(False)))

    def equals(self, x: Column, _, value) -> Column:
        if value is None:
            return F.is_variant_null(x)
        if isinstance(value, str):
            return (F.schema_of_variant(x) == "STRING") & (F.try_variant_get(x, "$", "string") == F.lit(value))
        if isinstance(value, bool | int | float):
            kind = "decimal(38,0)" if isinstance(value, int) and abs(value) >= EXACT else "double"
            return F.schema_of_variant(x).rlike(NUMBERS) & (F.try_variant_get(x, "$", kind) == F.lit(value).cast(kind))
        return F.lit(False)

    def bound(self, x: Column, _, op: str, value) -> Column:
        if isinstance(value, str):
            return (F.schema_of_variant(x) == "STRING") & getattr(F.try_variant_get(x, "$", "string"), BOUNDS[op])(F.lit(value))
        if isinstance(value, bool | int | float):
            found = getattr(F.try_variant_get(x, "$", "double"), BOUNDS[op])(F.lit(float(value)))
            if isinstance(value, int) and abs(value) >= EXACT:  # where doubles skip integers
                found = F.coalesce(getattr(F.try_variant_get(x, "$", "decimal(38,0)"), BOUNDS[op])(F.lit(value).cast("decimal(38,0)")), found)
            return F.schema_of_variant(x).rlike(NUMBERS) & found
        return F.lit(False)


def condition(field: Typed | Dynamic, wanted) -> Column:
    if isinstance(wanted, list | tuple | set):
        wanted = {"$in": list(wanted)}
    if not isinstance(wanted, dict):
        return field.test(lambda x, kind: field.equals(x, kind, wanted))
    parts = []
    if "$in" in wanted:
        parts.append(some([field.test(lambda x, kind, v=v: field.equals(x, kind, v)) for v in wanted["$in"]]))
    bounds = {op: v for op, v in wanted.items() if op in BOUNDS}
    if bounds:
        parts.append(field.test(lambda x, kind: every([field.bound(x, kind, op, v) for op, v in bounds.items()])))
    return some(parts)


def where(filters: dict | None, schema: T.StructType | None = None, metadata: Column | None = None) -> Column:
    """The filter as a Boolean column. Fields in schema are typed columns of the table, all others are looked up in metadata.

    Null counts as no match under a filter; wrap in coalesce() before negating.
    """
    if filters is not None and not isinstance(filters, dict):
        raise InvalidRecord("where has to be an object of field names and conditions")
    types = {f.name: f.dataType for f in schema.fields} if schema else {}
    out = []
    for name, wanted in (filters or {}).items():
        if name in types:
            out.append(condition(Typed(F.col(f"`{name}`"), types[name]), wanted))
        elif metadata is not None:
            out.append(condition(Dynamic(metadata, name), wanted))
        else:
            out.append(F.lit(False))
    return every(out)


def _document(content: Column, filters) -> Column:
    if not isinstance(filters, dict):
        return F.lit(False)
    out = []
    for op, operand in filters.items():
        if op == "$contains" and isinstance(operand, str):
            out.append(content.contains(F.lit(operand)))
        elif op == "$not_contains" and isinstance(operand, str):
            out.append(~content.contains(F.lit(operand)))
        elif op == "$and" and isinstance(operand, list):
            out.append(every([_document(content, x) for x in operand]))
        elif op == "$or" and isinstance(operand, list):
            out.append(some([_document(content, x) for x in operand]))
        else:
            return F.lit(False)
    return every(out)


def truthy(content: Column, is_text: Column | None = None) -> Column:
    """Documents that can match at all: not null, "", or JSON of an empty object or list, 0, false or null."""
    full = content.isNotNull() & (content != "")
    return full if is_text is None else full & (is_text | ~content.isin("{}", "[]", "0", "0.0", "false", "null", '""'))


def where_document(filters: dict | None, content: Column, is_text: Column | None = None) -> Column:
    """The filter as a Boolean column, never null. content: the canonical text. is_text: whether it was a text and not JSON."""
    if not filters:
        return F.lit(True)
    return F.coalesce(truthy(content, is_text) & _document(content, filters), F.lit(False))
