"""Command line: ``python -m clausewright PATH``."""

from __future__ import annotations

import argparse
import json
import sys

from clausewright.operators import rules
from clausewright.plans import report
from clausewright.session import local_session
from clausewright.sources import rulefiles
from clausewright.sources.trees import ScanOptions

VERSION = "0.2"


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="clausewright", description="Finds licences in a source tree.")
    parser.add_argument("path", nargs="?")
    parser.add_argument("--version", action="store_true", help="the version and the number of rules")
    parser.add_argument("--workers", type=int, help="tasks that read files at a time")
    parser.add_argument("--rules", help="a folder of .RULE and .LICENSE files to match instead of the built-in rules")
    parser.add_argument("--deny", default="", help="identifiers that make the run fail, with commas")
    parser.add_argument("--allow", default="", help="the only identifiers that don't, with commas")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--max-depth", type=int, default=32)
    parser.add_argument("--max-files", type=int)
    parser.add_argument("--max-file-size", type=int, default=1 << 20)
    parser.add_argument("--skip", default="", help="names of directories, with commas")
    parser.add_argument("--scope", choices=("project", "all"), default="project")
    parser.add_argument("--matched-text", action="store_true")
    a = parser.parse_args(arguments)
    if a.version:
        sys.stdout.write(f"clausewright {VERSION}, {len(rules.BUILTIN)} built-in rules\n")
        return 0
    if not a.path:
        parser.error("a path is needed")
    if a.scope == "all" and a.max_files is None:
        parser.error("--scope all needs --max-files")
    try:
        options = ScanOptions(a.max_depth, 10_000 if a.max_files is None else a.max_files, a.max_file_size, tuple(x.strip() for x in a.skip.split(",") if x.strip()), a.scope == "all", scanner_version=VERSION, workers=a.workers)
        spark = local_session()
        own = {}
        if a.rules:
            own = {"dictionary": rules.prepare(rulefiles.load_directory(spark, a.rules), rulefiles.load_mappings(a.rules)[1]), "maps": rulefiles.load_mappings(a.rules)}
        found = report.scan_repository(spark, a.path, options=options, matched_text=a.matched_text, **own)
    except (OSError, ValueError) as e:
        sys.stderr.write(f"clausewright: {e}\n")
        return 1
    sys.stdout.write(json.dumps(found, indent=2) + "\n" if a.json else report.human(found))
    if a.deny or a.allow:
        sys.stderr.write(report.gate_text(found, a.deny, a.allow))
        if report.denied(found, a.deny, a.allow):
            return 1
    return report.exit_code(found)


if __name__ == "__main__":
    sys.exit(main())
