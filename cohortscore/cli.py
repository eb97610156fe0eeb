"""Command line: list phenotypes and queries, run one query or several, fit and score, check a folder of tables."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession

from cohortscore.plans import registry
from cohortscore.plans.relation import TABLES
from cohortscore.sources import tables

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cohortscore", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list-phenotypes")
    sub.add_parser("list-queries")
    sub.add_parser("version")
    run = sub.add_parser("run", help="run one query and write it as gzipped text")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("output")
    sweep = sub.add_parser("sweep", help="run several queries, going on past failures")
    sweep.add_argument("tables")
    sweep.add_argument("output")
    sweep.add_argument("queries", nargs="+")
    fit = sub.add_parser("fit", help="load call files and a sample table, fit, score and evaluate")
    fit.add_argument("sample_table")
    fit.add_argument("target")
    fit.add_argument("output")
    fit.add_argument("genotypes", nargs="+")
    fit.add_argument("--covariates", default="", help="names, comma-separated")
    fit.add_argument("--metadata")
    fit.add_argument("--annotations", help="a table of variant_id and columns of any kind, from which prior scales are learned")
    fit.add_argument("--trait", default="auto", choices=["auto", "binary", "quantitative"])
    fit.add_argument("--minimum-maf", type=float, default=0.01)
    fit.add_argument("--least-z", type=float, default=0.0)
    fit.add_argument("--seed", type=int, default=42)
    fit.add_argument("--validation-share", type=float, default=0.0, help="of the training samples, to choose the iterate by")
    fit.add_argument("--solver", default="auto", choices=["auto", "dense", "products"])
    fit.add_argument("--learn-priors", action="store_true", help="learn prior scales and class shapes")
    prepare = sub.add_parser("prepare", help="a phenotype's sample table from record tables (<name>.parquet below a folder, or catalog:<schema>)")
    cohort = sub.add_parser("run-cohort", help="from record tables to scores, for one phenotype")
    many = sub.add_parser("sweep-cohorts", help="the same for several phenotypes, going on past failures")
    for p_ in (prepare, cohort, many):
        p_.add_argument("records")
        p_.add_argument("output")
        p_.add_argument("--pcs", help="a table of sample_id and components")
    for p_ in (prepare, cohort):
        p_.add_argument("--phenotype", required=True, help="a name, an alias or a concept code")
    many.add_argument("--phenotypes", required=True, help="comma-separated")
    for p_ in (cohort, many):
        p_.add_argument("--genotypes", required=True, nargs="+")
        p_.add_argument("--solver", default="auto", choices=["auto", "dense", "products"])
    evaluate = sub.add_parser("evaluate", help="measures of the predictions of a complete run")
    evaluate.add_argument("output")
    evaluate.add_argument("--samples", default="test", choices=["test", "all"])
    doctor = sub.add_parser("doctor", help="check that all tables can be read")
    doctor.add_argument("tables")
    return p


def code_of(asked: str) -> int:
    """A phenotype's concept code, by name or alias; a number is a code."""
    return int(asked) if asked.isdigit() else int(tables.PHENOTYPES[tables.resolve_alias(asked, {k: names for k, (_, names) in tables.PHENOTYPES.items()})][0])


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    if args.command == "list-phenotypes":
        print("\n".join(f"{k}\t{code}\t{', '.join(names)}" for k, (code, names) in sorted(tables.PHENOTYPES.items())))
        return 0
    queries = registry.queries()
    if args.command == "list-queries":
        print("\n".join(sorted(queries)))
        return 0
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "fit":
        from cohortscore.plans import run
        from cohortscore.sources.dataset import load_dataset

        names = [c for c in args.covariates.split(",") if c]
        data = load_dataset(spark, args.genotypes, args.sample_table, args.target, names, metadata=args.metadata)
        summary = run.run(spark, data, names, args.output, args.trait, args.minimum_maf, args.least_z, seed=args.seed, validation_share=args.validation_share, learn_priors=args.learn_priors, solver=args.solver, annotations=tables.delimited(spark, args.annotations) if args.annotations else None)
        print(json.dumps(summary))
        return 0 if summary["converged"] else 3
    if args.command in ("prepare", "run-cohort", "sweep-cohorts"):
        from cohortscore.plans import cohort

        records = cohort.records_of(spark, args.records)
        pcs = tables.delimited(spark, args.pcs) if args.pcs else None

        def one(name: str, output: str) -> dict:
            if args.command == "prepare":
                return cohort.prepare(spark, records, code_of(name), output, pcs=pcs)
            return cohort.run_cohort(spark, records, code_of(name), args.genotypes, output, pcs=pcs, solver=args.solver)

        if args.command != "sweep-cohorts":
            print(json.dumps(one(args.phenotype, args.output)))
            return 0
        failed = 0
        for name in args.phenotypes.split(","):
            try:
                one(name, os.path.join(args.output, name))
                print(f"{name}: COMPLETE")
            except Exception as e:
                failed += 1
                print(f"{name}: FAILED {type(e).__name__}: {e}")
        return int(failed > 0)
    if args.command == "evaluate":
        from cohortscore.plans import run

        print(json.dumps(run.evaluate_output(spark, args.output, args.samples == "test")))
        return 0
    if args.command == "doctor":
        bad = 0
        for t in TABLES:
            try:
                print(f"{t}: {len(spark.read.parquet(f'{args.tables}/{t}.parquet').columns)} columns")
            except Exception as e:
                bad += 1
                print(f"{t}: {type(e).__name__}")
        return int(bad > 0)
    failed = 0
    for name in [args.query] if args.command == "run" else args.queries:
        try:
            tables.write_table(queries[name](spark, args.tables), args.output if args.command == "run" else os.path.join(args.output, name))
            print(f"{name}: COMPLETE")
        except Exception as e:
            if args.command == "run":
                raise
            failed += 1
            print(f"{name}: FAILED {type(e).__name__}")
    return int(failed > 0)


if __name__ == "__main__":
    raise SystemExit(main())
