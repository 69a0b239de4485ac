"""Runs from the command line: python -m tessera.cli --family all --n 200 --out DIR, or --from-file PROBLEMS.jsonl --out DIR.

DIR gets `manifest` (JSON lines, in parts that are committed one by one) and `images` (a PNG file for each problem, by its id). Exit codes: 0 all is out; 1 an error, or
rows of a file that weren't emitted; 2 a run that fell short of n.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import families as fam
from tessera.operators import images, records, structured
from tessera.operators.storage import stored
from tessera.plans import report, runs
from tessera.plans.queries import ceiling
from tessera.sources import manifest

#: Options that only draws have.
DRAW_ONLY = ("--family", "--n", "--seed", "--max-draws")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description="Emit verified geometry problems.")
    p.add_argument("--family", default="all", help="a family, or all")
    p.add_argument("--n", type=int, default=100, help="problems to emit")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--max-draws", type=int, help="draws at most; 200 for each problem by default")
    p.add_argument("--from-file", metavar="PROBLEMS.jsonl", help="one problem for each row of a file in the place of draws")
    p.add_argument("--out", help="folder of the manifest and the figures")
    p.add_argument("--precision", type=int, default=6, help="places at which parameters count as equal")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--resume", action="store_true", help="carry on a run that was stopped: what it has committed stays")
    p.add_argument("--part-size", type=int, default=100_000, help="records that are committed at once")
    p.add_argument("--report", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--list-families", action="store_true")
    return p


def warn(message: str) -> None:
    print(f"warning: {message}", file=sys.stderr, flush=True)


def _write(records_: DataFrame, figures: DataFrame, number: str | None, args: argparse.Namespace) -> None:
    """The manifest first: a record that isn't valid leaves no figure behind. Then a file for each figure, where its record says."""
    if number is None:
        manifest.write(records_, f"{args.out}/manifest", args.overwrite)
    else:
        manifest.write_parts(records_, f"{args.out}/manifest", number, args.part_size, args.resume, args.overwrite)
    figures = figures.select(records.image_path(F.col("problem_id")).alias("image_path"), "spec", "stem")
    images.write_images(figures, args.out).agg(F.sum("bytes")).collect()


def _drawn(spark: SparkSession, args: argparse.Namespace) -> int:
    families = fam.available() if args.family == "all" else [args.family]
    ceilings = {f: ceiling(spark, fam.get(f), args.precision).first().ceiling for f in families}
    if all(c is not None for c in ceilings.values()) and args.n > sum(ceilings.values()):
        warn(f"{', '.join(families)}: {sum(ceilings.values())} unique valid combinations; n={args.n} requested -- will emit at most {sum(ceilings.values())} and then stop")
    prefix = runs.run(spark, families, args.n, args.seed, args.max_draws, args.family == "all", args.precision)
    _write(runs.records_of(prefix, args.seed), prefix.where("is_first"), "out", args)
    if args.report:
        print(report.run_text(prefix, families, args.n, args.seed, ceilings))
    r = runs.report(prefix).first()
    if r.emitted < args.n:
        why = report.stopped_early(prefix, args.n, ceilings)
        short = f"stopped after {r.draws} draws with {r.emitted}/{args.n} emitted. The parameter space may be smaller than the request; raise --max-draws or lower --n."
        print(f"stopped early: {why}" if why else short, file=sys.stderr)
        return 2
    return 0


def _from_file(spark: SparkSession, args: argparse.Namespace) -> int:
    found = stored(structured.statuses(structured.read_lines(spark, args.from_file), args.precision), "statuses")
    _write(structured.emitted_records(found), structured.figures(found), None, args)
    if args.report:
        for line in report.file_lines(found, args.from_file.rstrip("/").rsplit("/", 1)[-1]):
            print(line)
    failed = found.where("status != 'emitted'").select("line", "input_id", "status", "detail").orderBy("line")
    n = failed.count()
    if n:
        print(f"{n} of {found.count()} rows were not emitted:", file=sys.stderr)
        for x in failed.toLocalIterator():
            print(f"  line {x.line} {x.input_id or '<no input_id>'}: {x.status}: {x.detail}", file=sys.stderr)
    return 1 if n else 0


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    given = list(sys.argv[1:] if argv is None else argv)
    p = parser()
    args = p.parse_args(given)
    if args.list_families:
        print("\n".join(fam.available()))
        return 0
    if args.out is None:
        p.error("--out is required when generating")
    if args.from_file:
        both = [o for o in DRAW_ONLY if any(g == o or g.startswith(o + "=") for g in given)]
        if both:
            p.error(f"--from-file cannot be combined with {', '.join(both)}")
    elif args.n <= 0:
        p.error("--n must be positive")
    elif args.family != "all" and args.family not in fam.available():
        print(f"unknown family {args.family!r}; registered: {fam.available()}", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    try:
        return (_from_file if args.from_file else _drawn)(spark, args)
    except (ValueError, PySparkException) as e:
        print(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
