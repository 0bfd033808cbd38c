"""The property graph: schemas, identity of nodes and edges, resource identifiers.

Nodes are keyed by ``md5(name)`` and edges by ``md5(subject_predicate_object)``, so imports and change streams
that name a row alike converge on one node without looking anything up.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("count", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("byname", T.StringType()),
        T.StructField("datasource", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)
EDGE = T.StructType(
    [
        T.StructField("relationship_id", T.StringType(), False),
        T.StructField("subject_id", T.StringType()),
        T.StructField("object_id", T.StringType()),
        T.StructField("predicate", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("occurrence_time", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)

# Entity types, the default type of a row, the type that is never stored.
ENTITY_TYPES = ("person", "organization", "location", "event", "concept", "other")
ROW_TYPE = "其他"
UNSTORED_TYPE = "time"
FK_PREDICATE = "Foreign key"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_str(c: Column | str) -> Column:
    """Text of a value as descriptions show it: a null is the word None."""
    return F.coalesce(as_column(c).cast("string"), F.lit("None"))


def pk_value(*keys: Column | str, strict: bool = False) -> Column:
    """Key parts joined by a colon; null if a part is null or empty (*strict*: or blank, or the word None)."""
    texts = [as_column(k).cast("string") for k in keys]
    whole = F.lit(True)
    for t in texts:
        fine = (~F.trim(t).isin("", "None")) if strict else (t != "")
        whole = whole & F.coalesce(fine, F.lit(False))
    return F.when(whole, F.concat_ws(":", *texts))


def entity_name(table: str, *keys: Column | str, strict: bool = False) -> Column:
    """``table:key1:key2``, or null where the key is missing."""
    return F.concat(F.lit(f"{table}:"), pk_value(*keys, strict=strict))


def entity_id(name: Column | str) -> Column:
    return F.md5(as_column(name).cast("binary"))


def relationship_id(subject: Column | str, predicate: Column | str, obj: Column | str) -> Column:
    return F.md5(F.concat(as_column(subject), F.lit("_"), as_column(predicate), F.lit("_"), as_column(obj)).cast("binary"))


def describe(*columns: str, missing: str = "None") -> Column:
    """``col=value, col=value`` over *columns* in order."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(missing))) for c in columns]
    return F.concat_ws(", ", *parts)


def storable(nodes: DataFrame) -> DataFrame:
    """Nodes whose type may be stored; a missing type may."""
    return nodes.where(F.coalesce("type", F.lit("Entity")) != UNSTORED_TYPE)


def with_defaults(nodes: DataFrame) -> DataFrame:
    """The columns of a stored node with write-time defaults: count 1, confidence 0.5. Reads never replace nulls."""
    have = set(nodes.columns)
    defaults = {"count": F.lit(1), "confidence": F.lit(0.5)}
    column = lambda f: F.coalesce(F.col(f.name) if f.name in have else F.lit(None), defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
    return nodes.select(*[column(f) for f in NODE], *[c for c in nodes.columns if c not in NODE.names])


@dataclass(frozen=True)
class Resource:
    """``TYPE://uuid/path`` with TYPE DOC (documents) or DBS (databases)."""

    kind: str
    uuid: str
    path: str = ""

    def __str__(self) -> str:
        return f"{self.kind}://{self.uuid}/{self.path}" if self.path else f"{self.kind}://{self.uuid}"

    @property
    def file_name(self) -> str:
        """A name that is safe for files: no character but letters, digits, dot, dash, underscore."""
        return re.sub(r"[^\w.-]", "_", f"{self.kind}_{self.uuid}_{self.path}".rstrip("_"))

    @classmethod
    def parse(cls, text: str) -> Resource:
        m = re.fullmatch(r"(DOC|DBS)://([^/]+)(?:/(.*))?", text)
        if not m:
            raise ValueError(f"not a resource identifier: {text}")
        return cls(m[1], m[2], m[3] or "")


def uri(kind: str, uuid: str | Column, *path: str | Column) -> Column:
    parts = [p if isinstance(p, Column) else F.lit(p) for p in (uuid, *path)]
    return F.concat(F.lit(f"{kind}://"), F.concat_ws("/", *parts))


def uri_part(c: Column | str, part: str) -> Column:
    """One of ``kind``, ``uuid``, ``path`` of an identifier column; null if it is none."""
    group = {"kind": 1, "uuid": 2, "path": 3}[part]
    found = F.regexp_extract(as_column(c), r"^(DOC|DBS)://([^/]+)(?:/(.*))?$", group)
    return F.when(as_column(c).rlike(r"^(DOC|DBS)://[^/]+"), found)


def uuid_from_path(c: Column | str) -> Column:
    """The path segment after DOC or DBS in a file path."""
    return F.nullif(F.regexp_extract(as_column(c), r"(?:^|[/\\])(?:DOC|DBS)[/\\]([^/\\]+)", 1), F.lit(""))


def under(c: Column | str, prefix: str, strict: bool = False) -> Column:
    """Whether an identifier lies under *prefix*. Without *strict* ``…/user`` also matches ``…/users``."""
    c = as_column(c)
    if not strict:
        return c.startswith(prefix)
    base = prefix.rstrip("/")
    return (c == base) | c.startswith(base + "/")


def under_any(c: Column | str, prefixes: list[str]) -> Column:
    if not prefixes:
        return F.lit(False)
    return F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(as_column(c), p))


def exact_or_under(c: Column | str, value: str) -> Column:
    """Prefix test if *value* looks like an identifier, else equality."""
    return under(c, value) if "://" in value else as_column(c) == value
