"""Column functions of the vocabulary catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Prefixes that every schema may use, unless it declares its own.
KNOWN_PREFIXES = {
    "schema": "https://schema.org/",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "linkml": "https://w3id.org/linkml/",
    "bbqs": "https://brain-bbq-clone.lovable.app/schema#",
    "bids": "https://bids-specification.readthedocs.io/en/stable/",
    "nwb": "https://nwb-schema.readthedocs.io/en/latest/",
    "dandi": "https://schema.dandiarchive.org/",
    "openminds": "https://openminds.ebrains.eu/",
    "aind": "https://aind-data-schema.readthedocs.io/en/stable/",
}

# Primitive ranges and the XSD types they stand for.
PRIMITIVES = {
    "string": "xsd:string",
    "integer": "xsd:integer",
    "float": "xsd:float",
    "double": "xsd:double",
    "boolean": "xsd:boolean",
    "date": "xsd:date",
    "datetime": "xsd:dateTime",
    "uri": "xsd:anyURI",
    "uriorcurie": "xsd:anyURI",
    "curie": "xsd:anyURI",
}

#: Namespaces of things, and of schemas, that have no IRI of their own.
OBJECTS, SCHEMA_HOME = "https://example.org/obj/", "https://example.org/schema/"


def lookup(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def make_iri(c: Column, namespace: str = OBJECTS) -> Column:
    return F.concat(F.lit(namespace), c)


def resolve_prefix(curie: Column, prefixes: Column | None = None) -> Column:
    """Expand a CURIE. ``prefixes`` (a map, the schema's own) wins over the known ones; unknown prefixes stay."""
    head = F.substring_index(curie, ":", 1)
    rest = F.substr(curie, F.length(head) + 2)
    base = F.element_at(lookup(KNOWN_PREFIXES), head)
    if prefixes is not None:
        base = F.coalesce(F.element_at(F.coalesce(prefixes, F.create_map().cast("map<string,string>")), head), base)
    plain = ~F.contains(curie, F.lit(":")) | F.startswith(curie, F.lit("http://")) | F.startswith(curie, F.lit("https://"))
    return F.when(plain | base.isNull(), curie).otherwise(F.concat(base, rest))


def value_range(raw: Column, prefixes: Column | None = None) -> Column:
    """A primitive's XSD type, else the IRI of what the range names; no range is a string."""
    raw = F.when(raw.isNull() | (raw == ""), F.lit("string")).otherwise(raw)
    other = F.when(F.contains(raw, F.lit(":")), resolve_prefix(raw, prefixes)).otherwise(make_iri(raw))
    return F.coalesce(F.element_at(lookup(PRIMITIVES), raw), other)


# Fixed value: how a text names its units.
_UNITS = r"(?i)\(units?:\s*([^)]+)\)"


def any_units(text: Column) -> Column:
    """Units named in a text, ``(unit: x)`` or ``(units: x)``; else empty."""
    return or_empty(F.trim(F.regexp_extract(text, _UNITS, 1)))


def units(text: Column) -> Column:
    """As any_units, but only where the text has ``(units:``."""
    return F.when(F.contains(F.lower(text), F.lit("(units:")), any_units(text)).otherwise(F.lit(""))


def ascii_json(json: Column) -> Column:
    """Escape a JSON text to ASCII, characters beyond the base plane as surrogate pairs."""
    escaped = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    # JSON writers differ in the case of a control character's escape: lower case here
    lowered = F.regexp_replace(json, r"\\u001([A-F])", r"\\u001#$1")
    for c in "ABCDEF":
        lowered = F.replace(lowered, F.lit(f"\\u001#{c}"), F.lit(f"\\u001{c.lower()}"))
    for c in "BEF":
        lowered = F.replace(lowered, F.lit(f"\\u000{c}"), F.lit(f"\\u000{c.lower()}"))
    chars = F.transform(F.split(lowered, ""), lambda c: F.when(c.rlike("^[ -~]$") | (c == ""), c).otherwise(escaped(c)))
    return F.when(lowered.rlike("^[ -~]*$"), lowered).otherwise(F.array_join(chars, ""))


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON of ``fields`` with sorted keys, no spaces, nulls kept."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def normalised(c: Column, kind: T.DataType) -> Column:
    """A value of any type in canonical order, at every depth: fields and keys by name, lists of texts sorted, since they are sets of references, and
    other lists as they are. A list with a null in it is no list of texts. Nulls stay."""
    if isinstance(kind, T.StructType):
        fields = [normalised(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(c.isNotNull(), F.struct(*fields)) if fields else c
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType):
            return F.when(F.exists(c, lambda x: x.isNull()), c).otherwise(F.array_sort(c))
        return F.transform(c, lambda x: normalised(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("key"), normalised(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(F.array_sort(entries, lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0)))
    return c


def nested_hash(df: DataFrame, *names: str) -> Column:
    """The identity of content of the columns ``names`` of ``df``, whatever they hold."""
    return content_hash({n: normalised(F.col(n), df.schema[n].dataType) for n in names})


def json_around(fields: dict[str, Column], hole: str) -> tuple[Column, Column]:
    """The canonical ASCII JSON of ``fields`` and a field ``hole`` in two texts, before and behind the value of that field."""
    first, rest = ({k: c for k, c in fields.items() if (k < hole) is side} for side in (True, False))
    left = ascii_json(canonical_json(first)) if first else F.lit("{}")
    before = F.concat(F.left(left, F.length(left) - 1), F.lit(f'{"," if first else ""}"{hole}":'))
    return before, F.concat(F.lit(","), F.substr(ascii_json(canonical_json(rest)), F.lit(2))) if rest else F.lit("}")


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def content_hash(fields: dict[str, Column]) -> Column:
    """The identity of content: ``sha256:`` and the digest of its canonical ASCII JSON. Arrays must come sorted."""
    return digest(ascii_json(canonical_json(fields)))


def suffixed_name(name: Column, hash_id: Column) -> Column:
    """A name made unique by the first four digits of its hash."""
    return F.concat(name, F.lit("_"), F.substring(hash_id, 8, 4))


def _bumped(parts: Column, level: Column) -> Column:
    n = lambda k: F.get(parts, k).cast("int")
    zero = F.lit(0)
    major = F.array(n(0) + 1, zero, zero)
    minor = F.array(n(0), n(1) + 1, zero)
    patch = F.array(n(0), n(1), n(2) + 1)
    return F.when(level == "major", major).when(level == "minor", minor).otherwise(patch).cast("array<string>")


def bump_version(version: Column, level: Column) -> Column:
    """Next version of three parts; a level other than major or minor is a patch."""
    return F.array_join(_bumped(F.split(version, r"\."), level), ".")


def bump_padded(version: Column, level: Column) -> Column:
    """As bump_version, for versions of fewer parts, which count as 0, or of more, which stay."""
    parts = F.split(version, r"\.").cast("array<int>")
    padded = F.concat(parts, F.array_repeat(F.lit(0), F.greatest(F.lit(0), 3 - F.size(parts)))).cast("array<string>")
    return F.array_join(F.concat(_bumped(padded, level), F.slice(padded, F.lit(4), F.greatest(F.size(padded) - 3, F.lit(0)))), ".")


def next_registry_version(current: Column, level: Column) -> Column:
    return F.when(current == "0.0.0", F.lit("1.0.0")).otherwise(bump_version(current, level))


def skos_relation(distance: Column, is_subclass: Column) -> Column:
    """The mapping relation of a distance; bands are inclusive."""
    return (
        F.when(distance == 0, "exactMatch").when(distance <= 0.1, "closeMatch")
        .when(distance <= 0.4, F.when(is_subclass, "narrowMatch").otherwise("broadMatch"))
        .when(distance <= 0.7, "relatedMatch").otherwise("")
    )


def clean_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9_]", "_")


def clean(c: Column) -> Column:
    """As clean_name, without underscores at the ends."""
    return F.btrim(clean_name(c), F.lit("_"))


def camel(c: Column) -> Column:
    parts = F.filter(F.split(c, "[^a-zA-Z0-9]+"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "")


def agent_text(agent: Column, issue: Column) -> Column:
    return F.when(or_empty(issue) == "", agent).otherwise(F.concat(agent, F.lit(" (issue #"), issue, F.lit(")")))


def change_summary(classes: Column, properties: Column, provenance: Column) -> Column:
    return F.format_string("+%d classes, +%d props, %d provenance entries added", classes, properties, provenance)


def field_keys(record: Column) -> Column:
    """A JSON-LD record as a map: ``@`` keys go, and of other keys the part after the last colon stays."""
    own = F.map_filter(record, lambda k, _: ~F.startswith(k, F.lit("@")))
    return F.transform_keys(own, lambda k, _: F.element_at(F.split(k, ":"), -1))


def now_iso() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
