"""Command line: ``analyze``, ``run``, ``methods``, ``examples``, ``results``."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from eigenflux import config, registry, results
from eigenflux.session import session
from eigenflux.sources.generators import GENERATORS


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="eigenflux")
    sub = top.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze", help="one method over one case file or generator")
    a.add_argument("method")
    a.add_argument("--config")
    a.add_argument("--generator", choices=sorted(GENERATORS))
    a.add_argument("--rank")
    a.add_argument("--energy-fraction", type=float)
    for name, kind in (("nfft", int), ("overlap", float), ("delays", int), ("n-modes", int), ("max-snapshots", int)):
        a.add_argument(f"--{name}", type=kind)
    a.add_argument("--out")
    r = sub.add_parser("run", help="all runs of a suite file")
    r.add_argument("--config", required=True)
    r.add_argument("--out")
    r.add_argument("--dry-run", action="store_true")
    m = sub.add_parser("methods")
    m.add_argument("action", choices=["list", "show"])
    m.add_argument("name", nargs="?")
    e = sub.add_parser("examples")
    e.add_argument("action", choices=["list", "run"])
    e.add_argument("name", nargs="?")
    e.add_argument("--method", default="pod")
    i = sub.add_parser("results")
    i.add_argument("action", choices=["inspect"])
    i.add_argument("path")
    return top


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "methods" and args.action == "list":
        print("\n".join(f"{x.id}: {x.title}" for x in registry.METHODS.values()))
        return 0
    if args.command == "methods":
        x = registry.method(args.name or "")
        print(json.dumps({"id": x.id, "title": x.title, "kind": x.kind, "params": x.params}))
        return 0
    if args.command == "examples" and args.action == "list":
        print("\n".join(sorted(GENERATORS)))
        return 0
    spark = session()
    if args.command == "results":
        for row in results.inspect(spark, args.path).collect():
            print(f"{row['name']}: {row['rows']} rows, {row['columns']}")
        return 0
    if args.command == "run":
        rows = config.execute(spark, args.config, args.out, dry=args.dry_run).collect()
        for row in rows:
            print(f"[{'DONE' if row['executed'] else 'DRY-RUN' if args.dry_run else 'FAILED'}] {row['case']}/{row['run']} {row['saved'] or row['note']}")
        return int(any(row["note"].startswith("failed") for row in rows))
    if args.command == "examples":
        case, params = config.Case(args.name, {"kind": "generator", "name": args.name}), {}
    elif args.generator:
        case, params = config.Case(args.generator, {"kind": "generator", "name": args.generator}), {}
    else:
        case, runs = config.read(args.config)[0]
        params = next((r.params for r in runs if r.method == registry.method(args.method).id), {})
    if args.command == "analyze":
        rank = int(args.rank) if args.rank and args.rank.isdigit() else args.rank
        given = {"rank": rank, "nfft": args.nfft, "overlap": args.overlap, "delays": args.delays, "n_modes": args.n_modes, "energy_fraction": args.energy_fraction}
        params = params | {k: v for k, v in given.items() if v is not None}
        case = config.Case(case.name, case.data, case.settings | ({"max_snapshots": args.max_snapshots} if args.max_snapshots else {}))
    out = registry.run(args.method, case.load(spark), **params)
    print(out.save(f"{args.out}/{case.name}_{args.method}") if getattr(args, "out", None) else json.dumps(results.plain(out.attrs)))
    return 0
