"""The scan of a source tree: from files to one report, as JSON or plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.functions import policy
from clausewright.functions.expressions import Resolver
from clausewright.operators import detect, gate, match, rules
from clausewright.session import cut
from clausewright.sources import trees

SCHEMA_VERSION = 2


def with_policy(found: DataFrame, files: DataFrame) -> DataFrame:
    """Outside of legal files, references that run over the border of a block are clues."""
    facts = files.select("doc_id", "text", (F.size(policy.legal_roles(F.col("policy"))) > 0).alias("legal"), policy.uses_document_markers(F.col("policy")).alias("markers"))
    suspect = found.where((F.col("kind") == "reference") & ~F.col("is_clue")).join(facts.where("NOT legal"), "doc_id")
    crossing = suspect.where(policy.crosses_block_boundary(F.col("text"), F.col("start"), F.col("end"), F.col("markers"))).select("doc_id", "rule_id", "start", "end", F.lit(True).alias("crossing"))
    joined = found.join(crossing, ["doc_id", "rule_id", "start", "end"], "left")
    return joined.withColumn("is_clue", F.col("is_clue") | F.coalesce("crossing", F.lit(False))).select(*found.columns)


def scan_repository(spark: SparkSession, root: str, dictionary: DataFrame | None = None, options: trees.ScanOptions = trees.ScanOptions(), matched_text: bool = False, maps: tuple[dict[str, str], dict[str, str]] = (rules.SPDX_KEYS, rules.REPORTING), limit: int = match.MAX_CANDIDATES) -> dict:
    """The report of a tree. Matching is distributed; a report holds what the files with findings have, as the reader asked for it.
    ``maps``: SPDX identifiers to keys, and keys to reported identifiers. A file with more than ``limit`` candidates is an error."""
    dictionary = rules.builtin(spark) if dictionary is None else dictionary
    names = [r["expression"] for r in dictionary.where(~rules.has(rules.FALSE_POSITIVE)).select("expression").collect()]
    resolver = Resolver.of_rules(*maps, names)
    listing = trees.discover(root, options)
    contents = cut(trees.read(spark, listing, options, options.workers), "files")
    declared, errors = [], list(listing.errors)
    for r in contents.where("raw IS NOT NULL OR manifest_error IS NOT NULL").select("path", "raw", "named_file", "manifest_error").toLocalIterator():
        if r["manifest_error"] is not None:
            errors.append((r["path"], r["manifest_error"]))
        elif r["raw"] or r["named_file"]:
            declared.append({"path": r["path"], "raw": list(r["raw"]), "license_file": r["named_file"], "normalized_expression": resolver.lax(" OR ".join(r["raw"])) if r["raw"] else ""})
    declared.sort(key=lambda d: d["path"])
    files = contents.where("problem IS NULL")
    hits = cut(match.hits(files, dictionary), "hits")
    too_many = {r["doc_id"]: r["candidates"] for r in match.over_limit(hits, limit).collect()}  # one row a file at fault
    texts = files.where(~F.col("doc_id").isin(*too_many)) if too_many else files
    if too_many:
        errors += [(r["path"], f"{too_many[r['doc_id']]} candidates, {limit} are allowed") for r in files.where(F.col("doc_id").isin(*too_many)).select("doc_id", "path").collect()]
    matched = detect.of_hits(match.within_limit(hits, limit), dictionary)
    found = cut(with_policy(detect.with_tags(matched, texts.select("doc_id", "text"), resolver), files), "matches")
    covered = detect.coverage(found, files.select("doc_id", F.octet_length("text").cast("long").alias("bytes")))
    roles = policy.legal_roles(F.col("policy"))
    shown = files.withColumn("roles", roles).withColumn("is_root", ((policy.depth(F.col("path")) == 1) & (F.size("roles") > 0)) | policy.is_root_expression_file(F.col("path"))).join(detect.results(found), "doc_id", "left").join(covered, "doc_id")
    shown = shown.where(~F.col("doc_id").isin(*too_many)) if too_many else shown
    wanted = F.col("detections").isNotNull() | F.col("clues").isNotNull()
    if options.include_legal_files:
        wanted = wanted | (F.size("roles") > 0)
    records, expressions = [], {}
    summary = dict.fromkeys(("files_visited", "files_scanned", "files_with_detections", "files_with_identified_detections", "files_with_partial_detections", "files_with_noassertion_detections", "files_with_clues", "bytes_scanned", "directories_skipped", "files_skipped_binary", "files_skipped_size", "files_skipped_other", "error_count"), 0)

    def record(m, text: str, encoding: str) -> dict:
        d = {"rule_id": m["rule_id"], **({"license_ids": list(m["license_ids"])} if m["license_ids"] else {}), "kind": m["kind"], "method": m["method"], "score": m["score"], "coverage": m["coverage"]}
        d |= {"start": trees.raw_offset(text, encoding, m["start"]), "end": trees.raw_offset(text, encoding, m["end"])}
        return d | ({"matched": text.encode()[m["start"] : m["end"]].decode("utf-8", "replace")} if matched_text else {})

    for r in shown.where(wanted).orderBy("path").toLocalIterator():
        detections = [{"expression": d["expression"], "identification": d["identification"], "matches": [record(m, r["text"], r["encoding"]) for m in d["matches"]]} for d in r["detections"] or []]
        clues = [record(m, r["text"], r["encoding"]) for m in r["clues"] or []]
        records.append({"path": r["path"], "size": r["size"], "sha256": r["sha256"], "encoding": r["encoding"].removesuffix("-bom"), **({"text": r["text"]} if options.include_legal_files and r["roles"] else {}), "roles": list(r["roles"]), "license_text_coverage": r["coverage"], "detections": detections, "clues": clues})
        summary["files_with_detections"] += bool(detections)
        summary["files_with_clues"] += bool(clues)
        for state in {d["identification"] for d in detections}:
            summary[f"files_with_{state.lower()}_detections"] += 1
        for d in detections:
            e = expressions.setdefault(d["expression"], {"expression": d["expression"], "identification": d["identification"], "root": False, "files": 0, "matches": 0})
            e["root"] |= r["is_root"]
            e["files"] += 1
            e["matches"] += len(d["matches"])
    totals = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    skipped = list(listing.skipped)
    for r in contents.where("problem IS NOT NULL").select("path", "problem").toLocalIterator():
        if r["problem"].startswith("error: "):
            errors.append((r["path"], r["problem"][7:]))
        else:
            skipped.append((r["path"], r["problem"]))
    reasons = [reason for _, reason in skipped]
    summary |= {"files_visited": listing.visited, "files_scanned": totals["n"], "bytes_scanned": totals["bytes"], "directories_skipped": listing.directories_skipped}
    summary |= {"files_skipped_binary": reasons.count("binary"), "files_skipped_size": reasons.count("size"), "files_skipped_other": reasons.count("symlink") + reasons.count("not-regular"), "error_count": len(errors), "truncated": listing.truncated}
    return {"schema": SCHEMA_VERSION, "root": root, "scope": options.scope, "scanner": {"name": "clausewright", "version": options.scanner_version}, "corpus": {"version": "builtin", "rule_count": len(names), "source_commit": ""}, "summary": summary, "declared": declared, "expressions": [expressions[k] for k in sorted(expressions)], "files": records, "skipped": [{"path": p, "reason": r} for p, r in sorted(skipped)], "errors": [{"path": p, "error": e} for p, e in sorted(errors)]}


def exit_code(report: dict) -> int:
    """2 after errors or a cut-off listing, 3 if nothing was found, else 0."""
    if report["summary"]["error_count"] or report["summary"]["truncated"]:
        return 2
    return 0 if report["expressions"] else 3


def size_text(n: int) -> str:
    """A number of bytes in the largest unit of 1024 that it reaches."""
    for unit, name in ((1 << 30, "GiB"), (1 << 20, "MiB"), (1 << 10, "KiB")):
        if n >= unit:
            return f"{n / unit:.1f} {name}"
    return f"{n} B"


def summary_text(s: dict) -> str:
    parts = [f"{s['files_scanned']} of {s['files_visited']} files scanned ({size_text(s['bytes_scanned'])})", f"{s['files_with_detections']} with detections: identified in {s['files_with_identified_detections']}, partial in {s['files_with_partial_detections']}, NOASSERTION in {s['files_with_noassertion_detections']}", f"{s['files_with_clues']} with clues, {s['error_count']} errors"]
    if s["truncated"]:
        parts.append("the limit of files is reached")
    files = s["files_skipped_binary"] + s["files_skipped_size"] + s["files_skipped_other"]
    if files or s["directories_skipped"]:
        parts.append(f"skipped {files} files and {s['directories_skipped']} directories")
    return "; ".join(parts)


def denied(report: dict, deny: str = "", allow: str = "") -> list[tuple[str, str]]:
    """(path, expression) of the files with an expression that the policy denies."""
    bad = {e["expression"] for e in report["expressions"] if gate.denies(e["expression"], deny, allow)}
    return sorted({(f["path"], d["expression"]) for f in report["files"] for d in f["detections"] if d["expression"] in bad})


def gate_text(report: dict, deny: str = "", allow: str = "") -> str:
    """An annotation for each denied file, then a table of the expressions, those of the most files first."""
    lines = [f"::error file={path}::{expression} is not allowed here" for path, expression in denied(report, deny, allow)]
    table = sorted(report["expressions"], key=lambda e: (-e["files"], e["expression"]))
    return "\n".join([*lines, "| expression | files | matches |", "|---|---|---|", *(f"| {e['expression']} | {e['files']} | {e['matches']} |" for e in table)]) + "\n"


def human(report: dict) -> str:
    out = [f"{report['root']} ({report['scope']})", ""]
    out += [f"{e['expression']}  {e['identification']}  files {e['files']}, matches {e['matches']}{'  root' if e['root'] else ''}" for e in report["expressions"]] or ["No licences found."]
    for f in report["files"]:
        out += ["", f["path"], *(f"  {d['expression']}: {m['rule_id']} {m['method']} {m['start']}-{m['end']}" for d in f["detections"] for m in d["matches"]), *(f"  clue: {m['rule_id']} {m['start']}-{m['end']}" for m in f["clues"])]
    out += ["", *(f"skipped {s['path']}: {s['reason']}" for s in report["skipped"]), *(f"error {e['path']}: {e['error']}" for e in report["errors"])]
    return "\n".join([*out, "", summary_text(report["summary"])]) + "\n"
