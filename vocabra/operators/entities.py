"""Content-addressed entities of parsed schemas, and the edges between them."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import cut, shared_folder

#: Columns that a hash of each kind of entity must cover.
IDENTITY = {
    "property": ("description", "name", "property_range", "unit"),
    "class": ("class_mixins", "description", "is_abstract", "name", "parent_class", "properties"),
    "permissible_value": ("description", "meaning", "name"),
    "value_set": ("description", "name", "permissible_values"),
}


def hash_of(kind: str, fields: dict) -> F.Column:
    """The content hash of an entity; a missing identity field is an error, others are left out."""
    missing = sorted(set(IDENTITY[kind]) - set(fields))
    if missing:
        raise ValueError(f"{kind}: no {', '.join(missing)}")
    return S.content_hash({k: fields[k] for k in IDENTITY[kind]})


def _null_if_empty(c):
    return F.when(S.or_empty(c) != "", c)


def used(slots: DataFrame, uses: DataFrame, keys: list[str]) -> DataFrame:
    """The slots that something uses."""
    return slots.join(uses.select(*keys), keys, "left_semi")


def members(rows: DataFrame, owner: list[str], member: str, name: str) -> DataFrame:
    """For each owner the sorted array ``name`` of its distinct members."""
    return rows.groupBy(*owner).agg(F.sort_array(F.collect_set(member)).alias(name))


def unique_edges(rows: DataFrame) -> DataFrame:
    return rows.select("src", "dst").distinct()


def flattened(df: DataFrame, column: str) -> DataFrame:
    """The fields of a struct column in its place; nulls where it is null."""
    return df.select(*(c for c in df.columns if c != column), f"{column}.*")


def ancestors(edges: DataFrame) -> DataFrame:
    """node, ancestor and depth of all ancestors over edges (node, parent), the least depth where paths differ. A node in a cycle has itself
    among them, and one below a cycle all of its nodes, once.

    Paths double: those of up to 2m steps are those of up to m, and those of m steps with one of up to m behind. So a depth of d takes log2(d)
    rounds, each written before the next."""
    reach = cut(edges.where("node IS NOT NULL AND parent IS NOT NULL").select("node", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("depth")).distinct())
    steps = 1
    while not (far := reach.where(F.col("depth") == steps)).isEmpty():
        on = far.select("node", F.col("ancestor").alias("_via"), F.col("depth").alias("_steps"))
        more = on.join(reach.withColumnRenamed("node", "_via"), "_via").groupBy("node", "ancestor").agg(F.min(F.col("_steps") + F.col("depth")).alias("depth"))
        new = cut(more.join(reach.select("node", "ancestor"), ["node", "ancestor"], "left_anti"))
        reach, steps = cut(reach.unionByName(new)), 2 * steps
    return reach.select("node", "ancestor", F.col("depth").cast("int"))


def depths(nodes: DataFrame) -> DataFrame:
    """Nodes (scope, node, parent) with ``depth``, the number of their ancestors. Nodes in a cycle or below one, and those with an ancestor that is not
    there, have none and are left out. Pointers to ancestors double their length in each round."""
    key = ["scope", "node"]
    done = cut(nodes.where("parent IS NULL").select(*key, F.lit(0).alias("depth")))
    active = cut(nodes.where("parent IS NOT NULL").select(*key, F.col("parent").alias("up"), F.lit(1).alias("steps")))
    while not active.isEmpty():
        above = done.select("scope", F.col("node").alias("up"), "depth", F.lit(None).cast("string").alias("_up"), F.lit(None).cast("int").alias("_steps"))
        above = above.unionByName(active.select("scope", F.col("node").alias("up"), F.lit(None).cast("int").alias("depth"), F.col("up").alias("_up"), F.col("steps").alias("_steps")))
        moved = cut(active.join(above, ["scope", "up"]))
        ended = moved.where("depth IS NOT NULL").select(*key, (F.col("steps") + F.col("depth")).alias("depth"))
        if ended.isEmpty():  # depths have no gaps: what is left has none
            break
        done = cut(done.unionByName(ended))
        active = moved.where("depth IS NULL").select(*key, F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"))
    return done


#: Rounds of joins that chained_hashes() takes at most, whatever the depth.
ROUNDS = 16


def chained_hashes(nodes: DataFrame) -> DataFrame:
    """scope, node, hash_id and parent_hash of nodes (scope, node, parent, before, after): the digest of the texts ``before`` and ``after`` with the
    parent's hash_id between, as JSON. Nodes that depths() leaves out are left out.

    Levels are taken from the roots down, a join with the hashes of the level above each. Where there are more than ROUNDS of them, a
    round takes several: each node then has the texts of its nearest ancestors, which it folds into its own hash."""
    found = cut(nodes.join(depths(nodes.select("scope", "node", "parent")), ["scope", "node"]))
    deepest = found.agg(F.max("depth")).first()[0]
    if deepest is None:
        return found.select("scope", "node", F.lit(None).cast("string").alias("hash_id"), F.lit(None).cast("string").alias("parent_hash"))
    stride = -(-(deepest + 1) // ROUNDS)
    lines = found.select("scope", "node", "depth", F.col("parent").alias("above"), F.array(F.struct("before", "after")).alias("texts"))
    have = 1
    while have < stride:  # texts of as many nodes above as lie in the same stride, doubled each time
        inside = F.col("depth") % stride >= have  # the node ``have`` above is in it
        higher = lines.select("scope", F.col("node").alias("_at"), F.col("above").alias("_above"), F.col("texts").alias("_texts"))
        both = lines.withColumn("_at", F.when(inside, F.col("above"))).join(higher, ["scope", "_at"], "left")
        moved = F.col("_at").isNotNull()
        lines = cut(both.select("scope", "node", "depth", F.when(moved, F.col("_above")).otherwise(F.col("above")).alias("above"), F.when(moved, F.concat("_texts", "texts")).otherwise(F.col("texts")).alias("texts")))
        have *= 2
    folder = f"{shared_folder(nodes.sparkSession)}/levels-{uuid.uuid4().hex}"  # a folder for each round, which reads it alone
    lines.withColumn("round", F.floor(F.col("depth") / stride).cast("int")).repartitionByRange("round", "scope", "node").write.partitionBy("round").parquet(folder)
    start = F.when(F.col("top").isNotNull(), F.struct(F.col("top").alias("own"), F.lit(None).cast("string").alias("parent"))).otherwise(F.struct(F.lit(None).cast("string").alias("own"), F.lit(None).cast("string").alias("parent")))

    def fold(state, text):
        parent = F.when(state["own"].isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), state["own"], F.lit('"')))
        return F.struct(S.digest(F.concat(text["before"], parent, text["after"])).alias("own"), state["own"].alias("parent"))

    def hashed(rows: DataFrame) -> DataFrame:
        return rows.select("scope", "node", "depth", F.aggregate("texts", start, fold).alias("h")).select("scope", "node", "depth", F.col("h.own").alias("hash_id"), F.col("h.parent").alias("parent_hash"))

    none = F.lit(None).cast("string").alias("top")
    parts = []
    for n in range((deepest + stride) // stride):
        level = nodes.sparkSession.read.schema(lines.schema).parquet(f"{folder}/round={n}")
        if n:
            tops = parts[-1].where(F.col("depth") == n * stride - 1).select("scope", F.col("node").alias("above"), F.col("hash_id").alias("top"))
        parts.append(cut(hashed(level.join(tops, ["scope", "above"]) if n else level.withColumn("top", none))))
    return functools.reduce(DataFrame.unionByName, parts).drop("depth")


def keyed(elements: DataFrame) -> DataFrame:
    """Elements with ``path``, the file that they come from: two files may give one label."""
    return elements.withColumn("path", F.coalesce("path", F.lit("")) if "path" in elements.columns else F.lit(""))


#: What tells the schema of an element.
FILE = ["source_label", "path"]


def properties(elements: DataFrame) -> DataFrame:
    """Properties that some class uses: source_label, path, hash_id and their fields. The unit counts by its code alone."""
    elements = keyed(elements)
    slots = used(elements.where("kind = 'slot'"), elements.where("kind = 'class_slot'"), [*FILE, "name"])
    code = _null_if_empty(F.col("units"))
    fields = {"description": S.or_empty(F.col("definition")), "name": F.col("name"), "property_range": F.col("value"), "unit": F.when(code.isNotNull(), F.struct(code.alias("ucum_code")))}
    return slots.select(
        *FILE, hash_of("property", fields).alias("hash_id"), "name", fields["description"].alias("description"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
        _null_if_empty(F.col("iri")).alias("concept_uri"), F.col("value").alias("property_range"), code.alias("ucum_code"),
        *(F.lit(None).cast("string").alias(c) for c in ("has_quantity_kind", "symbol", "abbreviation", "descriptive_name")),
    )


def _class_rows(elements: DataFrame) -> DataFrame:
    """A row per class of a file, with ``scope``, which holds file and label."""
    rows = keyed(elements).where("kind = 'class'")
    return rows.select(*FILE, F.to_json(F.struct(*FILE)).alias("scope"), "name", F.col("value").alias("is_a"), F.col("definition").alias("description"), "iri", "is_abstract", "aliases")


def classes(elements: DataFrame, props: DataFrame) -> DataFrame:
    """Classes with the sorted hashes of their properties. A class's hash holds its parent's, so hashes are made from the roots down."""
    slots = keyed(elements).where("kind = 'class_slot'").select(*FILE, F.col("owner").alias("class"), "name")
    held = members(slots.join(keyed(props).select(*FILE, "name", F.col("hash_id").alias("p")), [*FILE, "name"]), [*FILE, "class"], "p", "properties")
    base = _class_rows(elements).join(held.withColumnRenamed("class", "name"), [*FILE, "name"], "left").withColumn("properties", F.coalesce("properties", F.array().cast("array<string>")))
    base = cut(base)
    none = F.array().cast("array<string>")
    before, after = S.json_around({"class_mixins": none, "description": S.or_empty(F.col("description")), "is_abstract": F.col("is_abstract"), "name": F.col("name"), "properties": F.col("properties")}, "parent_class")
    found = chained_hashes(base.select("scope", F.col("name").alias("node"), F.col("is_a").alias("parent"), before.alias("before"), after.alias("after")))
    out = base.join(found.withColumnRenamed("node", "name"), ["scope", "name"])
    return out.select(
        *FILE, "hash_id", "name", S.or_empty(F.col("description")).alias("description"), F.coalesce("aliases", none).alias("aliases"), _null_if_empty(F.col("iri")).alias("concept_uri"),
        F.col("parent_hash").alias("parent_class"), "is_abstract", "properties",
    )


def unrooted(elements: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """source_label, path and name of classes that classes() leaves out: those in a cycle of parents, or below one. ``found`` is what it gave,
    where that is known."""
    own = _class_rows(elements)
    if found is None:
        deep = depths(own.select("scope", F.col("name").alias("node"), F.col("is_a").alias("parent")))
        return own.join(deep.select("scope", F.col("node").alias("name")), ["scope", "name"], "left_anti").select(*FILE, "name")
    return own.select(*FILE, "name").join(found.select(*FILE, "name"), [*FILE, "name"], "left_anti")


def permissible_values(elements: DataFrame) -> DataFrame:
    rows = keyed(elements).where("kind = 'value'")
    fields = {"description": S.or_empty(F.col("definition")), "meaning": _null_if_empty(F.col("value")), "name": F.col("name")}
    return rows.select(
        *FILE, F.col("owner").alias("enum"), hash_of("permissible_value", fields).alias("hash_id"), "name", fields["description"].alias("description"),
        F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("concept_uri"), fields["meaning"].alias("meaning"),
    )


def value_sets(elements: DataFrame, values: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    members = values.groupBy(*FILE, F.col("enum").alias("name")).agg(F.sort_array(F.collect_list("hash_id")).alias("permissible_values"))
    rows = keyed(elements).where("kind = 'enum'").select(*FILE, "name", "definition", "iri").join(members, [*FILE, "name"], "left")
    rows = rows.withColumn("permissible_values", F.coalesce("permissible_values", none))
    fields = {"description": S.or_empty(F.col("definition")), "name": F.col("name"), "permissible_values": F.col("permissible_values")}
    return rows.select(
        *FILE, hash_of("value_set", fields).alias("hash_id"), "name", fields["description"].alias("description"), none.alias("aliases"), F.lit(None).cast("string").alias("concept_uri"), "permissible_values",
    )


def property_edges(classes_: DataFrame) -> DataFrame:
    return unique_edges(classes_.select(F.col("hash_id").alias("src"), F.explode("properties").alias("dst")))


def subclass_edges(classes_: DataFrame) -> DataFrame:
    return unique_edges(classes_.where("parent_class IS NOT NULL").select(F.col("hash_id").alias("src"), F.col("parent_class").alias("dst")))


def value_edges(sets: DataFrame) -> DataFrame:
    return unique_edges(sets.select(F.col("hash_id").alias("src"), F.explode("permissible_values").alias("dst")))


def distinct_entities(rows: DataFrame, keys: tuple[str, ...] = ("hash_id",), order: tuple[str, ...] = ("source_label",)) -> DataFrame:
    """One row per key, with ``attestations``, the rows it had; of several the first by ``order`` gives what the key does not cover,
    and the least of the rest where that ties."""
    columns = [c for c in rows.columns if c not in keys]
    first = [c for c in order if c in columns]
    ranked = F.struct(*first, *(c for c in columns if c not in first))
    one = rows.groupBy(*keys).agg(F.min(ranked).alias("row"), F.count(F.lit(1)).alias("attestations"))
    return one.select(*keys, *(F.col(f"row.{c}").alias(c) for c in columns), "attestations")
