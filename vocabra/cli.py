"""Command lines: python -m vocabra.cli pipeline | ingest | align | export | convert | seed | validate | counts."""

from __future__ import annotations

import argparse
import sys
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import snapshot, store
from .sources import converters, graphs, linkml


def _insert(db: store.Store, elements: DataFrame, args) -> int:
    """Insert all schemas of ``elements`` at once; 1 if a file was left out."""
    labels = [r.source_label for r in elements.where("kind = 'meta'").select("source_label").distinct().orderBy("source_label").collect()]  # a row per schema
    if args.wipe and not args.dry_run and labels:
        print(f"  removing the attestations of {', '.join(labels)}")
        store.wipe_sources(db, *labels)
    told = dict(agent=args.agent, issue=args.issue, registry_version=args.registry_version, dry_run=args.dry_run)
    rows = [r.asDict() for r in store.insert_all(db, elements, **told).orderBy("label").collect()]
    for r in rows:
        if r["error"]:
            print(f"  ERROR parsing {r['label']}: {r['error']}")
        else:
            print(f"  {r['label']}{' (dry run)' if args.dry_run else ''}: " + ", ".join(f"{k} {v}" for k, v in r.items() if k not in ("label", "error", "path") and v is not None))
    return int(any(r["error"] for r in rows))


def ingest(spark: SparkSession, args) -> int:
    """Ingest one schema file, or all of a folder; files that can't be parsed, or have a cycle of parents, are told and do not stop the others."""
    files = linkml.read_files(spark, args.file or f"{args.schemas.rstrip('/')}/*.yml")
    _insert(store.Store(spark, args.db), linkml.parse(linkml.with_imports(files)).persist(), args)
    return 0


def seed(spark: SparkSession, args) -> int:
    """Ingest the schema.org vocabulary from its JSON-LD file."""
    nodes = graphs.records(spark, args.file).select(F.col("pos").cast("int").alias("n"), F.from_json("record", "map<string,string>").alias("m"))
    elements = converters.schema_org_elements(nodes).withColumns({c: F.lit(None) for c in ("multivalued", "required", "pattern")})
    head = spark.createDataFrame([("meta", "schemaorg", "schemaorg", "1.0.0")], "kind string, source_label string, name string, value string")
    return _insert(store.Store(spark, args.db), elements.unionByName(head, allowMissingColumns=True), args)


def align(spark: SparkSession, args) -> int:
    pairs = store.write_alignments(store.Store(spark, args.db), args.registry_version, args.dry_run)
    print(f"{'Would write' if args.dry_run else 'Wrote'} {2 * pairs} edges from {pairs} exact matches.")
    return 0


def export(spark: SparkSession, args) -> int:
    version = snapshot.publish(store.Store(spark, args.db), args.out, bump=args.bump, issue=args.issue, agent=args.agent, schema=args.schema)
    print(f"Published {version} in {args.out}")
    return 0


def _convert(spark: SparkSession, args) -> int:
    named = dict(x.split("=", 1) for x in args.source)
    known = {**converters.FORMATS_OF, "bbqs": None}
    for name in (set(named) | set(args.only)) - set(known):
        print(f"  WARNING: unknown source {name}")
    files = {n: linkml.read_files(spark, *paths.split(",")) for n, paths in named.items() if n in known}
    none = spark.createDataFrame([], "path string, content string")
    seeds = [linkml.read_files(spark, *x.split(",")) if x else none for x in (args.aind_schemas, args.aind_elements)]

    def documents(name: str) -> DataFrame:
        if name == "bbqs":
            return converters.pass_through(files[name]).select(F.lit("bbqs").alias("label"), "content")
        if name == "aind":
            return converters.aind(files[name], *seeds)
        if name == "openminds" and args.modules:
            return converters.convert(converters.openminds_selection(files[name], args.modules, args.per_module), name)
        return converters.convert(files[name], name)

    only = tuple(n for n in args.only if n in files)
    if args.only and not only:
        return 1
    failed = converters.run_all({n: partial(documents, n) for n in files}, args.out, only, tuple(args.skip), files)
    for name, error in failed.items():
        print(f"  ERROR in {name}: {error}")
    return 1 if failed else 0


def convert(spark: SparkSession, args) -> int:
    """Convert sources given as name=files; 1 if any of them, or any file of them, failed."""
    return _convert(spark, args)


def pipeline(spark: SparkSession, args) -> int:
    """Everything in one: seed, convert, ingest, align and publish; stops at the first step that fails."""
    if args.fresh:
        store.Store(spark, args.db).drop()
        print(f"Deleted {args.db}")
    told = argparse.Namespace(**vars(args), wipe=False, dry_run=False, registry_version="", schema="")
    if args.seed_file and seed(spark, argparse.Namespace(**vars(told) | {"file": args.seed_file})):
        return 1
    if args.source and not args.skip_converters and _convert(spark, argparse.Namespace(**vars(told) | {"out": f"{args.out}/converted"})):
        return 1
    targets = args.schemas or [f"{args.folder.rstrip('/')}/*.yml"]
    if args.source and not args.skip_converters:
        targets.append(f"{args.out}/converted/*/*/part-*")
    try:
        files = linkml.read_files(spark, *targets)
        files = files.where(~F.col("path").rlike(r"/meta_model\.ya?ml$")).persist()
    except AnalysisException:
        files = None
    if files is None or files.isEmpty():
        print("No schemas found to ingest.")
        return 1
    if _insert(store.Store(spark, args.db), linkml.parse(linkml.with_imports(files)).persist(), told):
        return 1
    align(spark, told)
    export(spark, told)
    print("Pipeline complete.")
    return 0


def validate(spark: SparkSession, args) -> int:
    """1 if a schema has the wrong shape or names what it does not define."""
    bad = linkml.undefined_references(linkml.read_files(spark, *args.files)).orderBy("source_label", "kind", "owner", "name").collect()
    for r in bad:
        print(f"  - {r.source_label}: {r.kind} {r.owner} {r.name}")
    print("FAILED" if bad else "Valid")
    return 1 if bad else 0


def counts(spark: SparkSession, args) -> int:
    for r in store.label_counts(store.Store(spark, args.db)).collect():
        print(f"{r.label}: {r.n}")
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="vocabra")
    commands = out.add_subparsers(dest="command", required=True)

    def command(run, *options: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(run.__name__, help=run.__doc__)
        sub.set_defaults(run=run)
        for o in options:
            if o in ("dry-run", "wipe"):
                sub.add_argument(f"--{o}", action="store_true")
            else:
                sub.add_argument(f"--{o}", default={"db": "catalogue", "agent": "anonymous"}.get(o, ""))
        return sub

    own = ("db", "dry-run", "wipe", "registry-version", "issue", "agent")
    command(ingest, "file", *own).add_argument("--schemas", default="schemas")
    command(seed, *own).add_argument("--file", required=True)
    command(align, "db", "registry-version", "dry-run")
    sub = command(export, "db", "issue", "agent", "schema")
    sub.add_argument("--bump", default="minor", choices=["major", "minor", "patch"])
    sub.add_argument("--out", default="data")

    def sources(sub: argparse.ArgumentParser, many: str) -> None:
        sub.add_argument("source", nargs=many, help="name=files, several files with commas between")
        sub.add_argument("--only", action="append", default=[])
        sub.add_argument("--skip", action="append", default=[])
        sub.add_argument("--aind-schemas", default="", help="content-addressed AIND schemas, for want of models")
        sub.add_argument("--aind-elements", default="")
        sub.add_argument("--modules", type=int, default=0, help="of openMINDS take the last version, and so many modules of it")
        sub.add_argument("--per-module", type=int, default=8)

    sub = command(convert)
    sub.add_argument("--out", default="schemas")
    sources(sub, "+")
    sub = command(pipeline, "db", "issue", "agent")
    sub.add_argument("--fresh", action="store_true", help="delete the catalogue first")
    sub.add_argument("--skip-converters", action="store_true")
    sub.add_argument("--seed-file", default="", help="the schema.org vocabulary")
    sub.add_argument("--schemas", action="append", default=[], help="files to ingest, instead of those of the folder")
    sub.add_argument("--folder", default="schemas")
    sub.add_argument("--bump", default="minor", choices=["major", "minor", "patch"])
    sub.add_argument("--out", default="data")
    sources(sub, "*")
    command(validate).add_argument("files", nargs="+")
    command(counts, "db")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(SparkSession.builder.getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
