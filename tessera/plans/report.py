"""Reports of runs as text. What is gathered is one row of totals and one for each cause or family; rows of a file come one by one."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from tessera.operators import structured
from tessera.plans import runs


def _line(label: str, value: object) -> str:
    return f"{label:<22}: {value}"


def _listed(title: str, counts: list[tuple[str, int]]) -> list[str]:
    return [f"{title:<22}:", *[f"    {n:6d}  {name}" for name, n in counts]] if counts else []


def stopped_early(prefix: DataFrame, n: int, ceilings: dict[str, int | None], streak: int = 5000) -> str | None:
    """Why a run ended before its n problems and its draws were out, if it did."""
    r = runs.report(prefix).first()
    if r.emitted >= n:
        return None
    own = {f: r.by_family.get(f, 0) for f in ceilings}
    full = {f: c for f, c in ceilings.items() if c is not None and own[f] >= c}
    if len(ceilings) == 1 and full:
        ((family, limit),) = full.items()
        return f"{family} has emitted all {limit} of its unique valid combinations; stopping at {r.emitted}/{n} emitted"
    if len(ceilings) == len(full):
        return f"every family is exhausted; stopping at {r.emitted}/{n} emitted"
    open_ = [f for f in ceilings if f not in full]
    idle = prefix.where(prefix["family"].isin(open_)).selectExpr("family", "ord", "if(is_first, ord, 0) AS at").groupBy("family").agg({"ord": "max", "at": "max"}).collect()
    if all(x["max(ord)"] - x["max(at)"] >= streak for x in idle) and len(idle) == len(open_):
        return f"no new unique problems found after {streak} consecutive duplicate or rejected draws; stopping early at {r.emitted}/{n} emitted"
    return None


def run_text(prefix: DataFrame, families: list[str], n: int, seed: int, ceilings: dict[str, int | None]) -> str:
    """The report of a drawn run."""
    r = runs.report(prefix).first()
    valid = r.draws - r.invalid
    lines = [_line("family", families[0] if len(families) == 1 else ", ".join(sorted(families))), _line("seed", seed), _line("emitted", f"{r.emitted}/{n}" + ("" if r.emitted >= n else "   *** SHORT ***")), _line("draws", r.draws)]
    if ceilings:
        lines.append(_line("ceiling", ", ".join(f"{f} {'unknown' if c is None else c}" for f, c in sorted(ceilings.items()))))
    if why := stopped_early(prefix, n, ceilings):
        lines.append(_line("stopped early", why))
    lines += [
        _line("acceptance rate", f"{r.acceptance_rate:.1%} ({valid} valid, {r.invalid} rejected)"),
        _line("collision rate", f"{r.collision_rate:.1%} ({r.duplicates} duplicates of {valid} valid)"),
        _line("verified", f"{r.emitted} (worst relative difference {r.worst_difference or 0.0:.2e})"),
    ]
    if len(r.by_family) > 1:
        lines += _listed("emitted by family", sorted(r.by_family.items()))
    return "\n".join(lines + _listed("rejections by cause", [(x.cause, x.n) for x in runs.causes(prefix).collect()]))


def file_lines(found: DataFrame, name: str) -> Iterator[str]:
    """The report of a file's run, line by line."""
    r = structured.file_report(found).first()
    yield _line("input", f"from-file {name}")
    yield _line("emitted", f"{r.emitted}/{r.requested}" + ("" if r.emitted >= r.requested else "   *** INCOMPLETE ***"))
    for label, status in (("input errors", "input_error"), ("geometry rejected", "geometry_rejected"), ("answer mismatches", "answer_mismatch"), ("duplicates", "duplicate"), ("other errors", "error")):
        yield _line(label, r[status])
    yield _line("verified", f"{r.emitted} (worst relative difference {r.worst_difference:.2e})")
    yield _line("readability warnings", f"{r.warned} rows")
    if len(r.by_family) > 1:
        yield from _listed("emitted by family", sorted(r.by_family.items()))
    yield f"{'rows':<22}:"
    for x in found.select("line", "input_id", "family", "status", "detail", "warnings", "answer_exact").orderBy("line").toLocalIterator():
        good = x.status == "emitted"
        yield f"    {'PASS' if good else 'FAIL'}  line {x.line}  {x.input_id or '<no input_id>'} [{x.family or '?'}]  " + (f"answer={x.answer_exact}" if good else f"{x.status}: {x.detail}")
        for w in x.warnings or ():
            yield f"            readability warning (not blocking): {w}"
