"""``python -m tracelight.cli COMMAND``: a project's store from the command line.

Exit codes: 0 nothing found or all well, 1 found, 10 open, 5 incomplete, others an error (operators/rules.py).
"""

from __future__ import annotations

import argparse
import json
import sys

from tracelight.plans.session import EXIT_CODES, Session, report_text
from tracelight.sources.documents import Config, DocumentError, canonical_json

COMMANDS = ("init", "protect", "generate", "verify", "scan", "inspect", "report", "registry", "badge", "compliance", "pre-commit")
VIEWS = ("store", "identity", "config", "releases", "fragments", "families", "reports", "omissions")


def _edits(a: str, b: str) -> int:
    """Letters to insert, remove or replace to make one word the other."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def nearest(typed: str) -> str | None:
    """The command that was meant, if one is at most two edits away."""
    distance, best = min((_edits(typed, c), c) for c in COMMANDS)
    return best if distance <= 2 else None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracelight", description="Write codes into source, find them again.")
    p.add_argument("--project", default=".", help="a folder at or below the project's root")
    p.add_argument("--json", action="store_true", help="whole documents instead of text")
    p.add_argument("--limit", type=int, default=24, help="rows of evidence to show")
    sub = p.add_subparsers(dest="command", required=True, parser_class=argparse.ArgumentParser)
    one = {c: sub.add_parser(c) for c in COMMANDS}
    one["init"].add_argument("--targets", nargs="+", default=["src"])
    one["init"].add_argument("--sites", type=int, default=24)
    one["init"].add_argument("--bits", type=int, default=4)
    for c in ("protect", "generate"):
        one[c].add_argument("--release")
        one[c].add_argument("--output", help="where the changed tree goes; back to where it was if left out")
    for c in ("verify", "pre-commit"):
        one[c].add_argument("--release")
    one["scan"].add_argument("candidate")
    one["scan"].add_argument("--release", action="append")
    one["scan"].add_argument("--save", metavar="NAME")
    one["inspect"].add_argument("view", choices=VIEWS, nargs="?", default="store")
    for c in ("report", "badge", "compliance"):
        one[c].add_argument("name", nargs="?", help="a saved report; the list if left out")
    return p


def run(args: argparse.Namespace, spark, out=print) -> int:
    say = lambda value, text: out(canonical_json(value).decode() if args.json else text)
    if args.command == "init":
        s = Session.init(spark, args.project, Config(targets=tuple(args.targets), target_sites=args.sites, tag_bits=args.bits))
        say({"store": str(s.store.path)}, f"store at {s.store.path}")
        return 0
    s = Session.discover(spark, args.project)
    if args.command in ("protect", "generate"):
        summary = s.protect(args.output, args.release, dry_run=args.command == "generate")
        say(summary, f"{summary['release_id']}: {summary['sites']} sites in {summary['files']} files")
        return 0
    if args.command in ("verify", "pre-commit"):
        d = s.verify(args.release)
        say(d, f"{d['verdict']}  {d['confirmed']} of {d['expected']} sites of {d['release_id']}")
        return EXIT_CODES[d["verdict"]]
    if args.command == "scan":
        report = s.scan(args.candidate, args.release, save=args.save)
        say(report, report_text(report, args.limit))
        return EXIT_CODES[report["outcome"]]
    if args.command == "inspect":
        rows = [r.asDict() for r in s.view(args.view).limit(args.limit).collect()]
        say(rows, "\n".join(json.dumps(r) for r in rows))
        return 0
    if args.command == "registry":
        say(s.registry(), "\n".join(f"{r['release_id']}  {r['created_at']}  {r['sites']} sites" for r in s.registry()["releases"]))
        return 0
    if args.name is None:
        say(s.store.reports(), "\n".join(s.store.reports()))
        return 0
    report = s.store.report(args.name)
    document = {"report": lambda: report, "badge": lambda: s.badge(report), "compliance": lambda: s.compliance(report)}[args.command]()
    say(document, report_text(report, args.limit) if args.command == "report" else json.dumps(document, indent=1))
    return 0


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    words = [a for a in argv if not a.startswith("-")]
    if words and not any(w in COMMANDS for w in words) and (meant := nearest(words[-1])):
        print(f"no command {words[-1]}; did you mean {meant}?", file=sys.stderr)
        return 2
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        return run(args, spark)
    except (DocumentError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
