"""Command line over the stages: python -m factloom.cli STAGE ... Each stage reads tables, runs one plan and writes a table.

A configuration (--config, YAML) gives a stage's options by their names, with ${NAME:-default} from the environment; what
stands on the command line goes before it. Results are versions behind a pointer (see sources.versions): a stage that finds one at
--out stops unless --replace is given, and one that fails leaves it as it was."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import core
from factloom.operators import distractors
from factloom.plans import catalog, packing, templates, validate
from factloom.sources import payloads, tables, versions

Stage = Callable[[SparkSession, argparse.Namespace], DataFrame | None]
STAGES: dict[str, tuple[Stage, str, dict[str, dict]]] = {}


def stage(name: str, /, **options: dict) -> Callable[[Stage], Stage]:
    """Registers a stage with its options, as argparse takes them."""

    def add(f: Stage) -> Stage:
        STAGES[name] = f, (f.__doc__ or "").strip(), options
        return f

    return add


def table(spark: SparkSession, path: str) -> DataFrame:
    """The current version at a path, or the Parquet table there."""
    return versions.read_version(spark, path) if versions.current(spark, path) else spark.read.parquet(path)


@stage("normalize", root={"required": True}, domain={"required": True}, contact={}, catalog={"help": "CSV of series with a header"}, lines={"action": "store_true"})
def normalize(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """raw payloads to facts"""
    more = {"catalog": spark.read.option("header", True).csv(args.catalog)} if args.catalog else {}
    return payloads.load(spark, args.root, args.domain, args.lines, args.contact, **more)


@stage("generate-questions", facts={"required": True}, domain={"required": True}, total={"type": int, "default": 100}, seed={"default": "families"})
def generate_questions(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """facts to question families of a domain"""
    return templates.generate(table(spark, args.facts), args.domain, args.total, args.seed)


@stage("build-contexts", facts={"required": True}, targets={"required": True, "help": "target_id and the columns of facts"}, lengths={"type": int, "nargs": "+", "default": [512, 1024, 2048]}, seed={"default": "distractors"})
def build_contexts(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """facts and targets to packed contexts"""
    facts, targets = table(spark, args.facts), table(spark, args.targets)
    fields = [(c, F.col(c)) for c in ("entity_id", "concept", "period", "unit", "value", "version")]
    sized = facts.select("record_id", core.token_count(core.render_record(core.display_id(args.seed, F.col("record_id")), fields, [])).alias("tokens"))
    chosen = distractors.candidates(facts, targets, max(args.lengths) // 24 + 256, args.seed).join(sized, "record_id")
    gold = targets.select("target_id", "record_id", F.lit(0).alias("ord")).join(sized, "record_id")
    named = lambda df: df.withColumnRenamed("target_id", "family_id")
    return packing.pack(named(chosen), named(gold), tuple(args.lengths))


@stage("validate", tables={"required": True, "help": "folder of facts, families, instances, placements, unavailable"}, strict={"action": "store_true"}, checks={"nargs": "+"})
def validate_tables(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """all checks of a dataset; the exit code is 1 where one of them fails (with --strict warnings count too)"""
    t = {n: table(spark, f"{args.tables.rstrip('/')}/{n}") for n in ("facts", "families", "instances", "placements", "unavailable")}
    rows = validate.report(t, args.checks)
    args.code = validate.exit_code(rows, args.strict)
    return rows


@stage("query", name={"required": True}, data={"required": True, "help": "folder of the tables"})
def query(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """one registered query"""
    if args.name not in catalog.QUERIES:
        raise SystemExit(f"no query {args.name}; there are {', '.join(sorted(catalog.QUERIES))}")
    return catalog.QUERIES[args.name](spark, args.data)


@stage("stats", facts={"required": True})
def stats(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """facts by domain and record type"""
    f = table(spark, args.facts)
    keys = [c for c in ("domain", "record_type") if c in f.columns]
    return f.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("n_entities"), F.countDistinct("concept").alias("n_concepts"))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="factloom", description="Stages of a benchmark's tables, and its queries.")
    sub = top.add_subparsers(dest="stage", required=True)
    for name, (_, text, options) in STAGES.items():
        p = sub.add_parser(name, help=text)
        p.add_argument("--config", help="YAML with the stage's options")
        p.add_argument("--out", help="where the result's version goes; without it 20 rows are shown")
        p.add_argument("--replace", action="store_true", help="let the result replace the version at --out")
        for option, how in options.items():
            p.add_argument(f"--{option}", **{**how, "required": False})
    return top


def parsed(argv: list[str]) -> argparse.Namespace:
    """The command line over the configuration over the defaults; options that a stage needs must be in one of them."""
    top = parser()
    args, options = top.parse_args(argv), STAGES[top.parse_args(argv).stage][2]
    if args.config:
        known = {*options, "out", "replace"}
        found = {k.replace("-", "_"): v for k, v in tables.run_config(Path(args.config).read_text()).items()}
        if unknown := sorted(set(found) - known):
            top.error(f"the configuration has options that {args.stage} doesn't: {', '.join(unknown)}")
        given = {a.lstrip("-").split("=")[0] for a in argv if a.startswith("--")}
        for k, v in found.items():
            if k not in given:
                setattr(args, k, v)
    for option, how in options.items():
        if how.get("required") and getattr(args, option) is None:
            top.error(f"{args.stage} needs --{option}")
    return args


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parsed(sys.argv[1:] if argv is None else argv)
    args.code, own = 0, spark is None
    spark = spark or SparkSession.builder.appName(f"factloom {args.stage}").getOrCreate()
    try:
        now = versions.current(spark, args.out) if args.out else None
        if now and not args.replace:
            raise SystemExit(f"{args.out} has a version; --replace lets this one follow it")
        out = STAGES[args.stage][0](spark, args)
        if args.out:
            print(json.dumps({"stage": args.stage, "out": args.out, "version": versions.commit(out, args.out, replaces=now)}))
        else:
            out.show(20, truncate=60)
        return args.code
    finally:
        if own:
            spark.stop()


if __name__ == "__main__":
    sys.exit(main())
