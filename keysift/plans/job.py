"""The scan as a job: ``spark-submit -m``-style entry with the usual switches.

    python -m keysift.plans.job --local /data/checkout --output-format all --output /data/out
    python -m keysift.plans.job --table /data/snapshots --repos /data/repos --output /data/out

A snapshot table has the columns repo, path and content.  The exit code is 1 when
high-risk findings exist and ``--fail-on-high`` is given, 2 when something could not be scanned
(listed in ``unscanned.json`` with the reason) unless ``--allow-unscanned`` is given.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from keysift.operators.pieces import detect_in_pieces
from keysift.options import ScanOptions
from keysift.plans.scan import scan
from keysift.session import materialize
from keysift.sinks.reports import FORMATS, write_documents, write_reports
from keysift.sources import baseline as baselines
from keysift.sources.blame import parse_porcelain
from keysift.sources.files import active_only, from_table, label_repos, within_limits
from keysift.sources.patterns import load_custom_patterns
from keysift.sources.tree import (
    list_tree, over_limit, read_pieces, scan_tree, tree_roots, unscanned,
)


# Reasons named in the printout.
_SHOWN = 20


def _arguments(argv: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="keysift", description="Find credentials in files")
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--local", metavar="PATH", help="directory tree to scan")
    source.add_argument("--table", metavar="PATH", help="parquet table (repo, path, content)")
    parser.add_argument("--repos", metavar="PATH", help="parquet table (repo, archived)")
    parser.add_argument("--blame", metavar="PATH", help="parquet table (repo, path, porcelain)")
    parser.add_argument("--max-depth", type=int)
    parser.add_argument("--scan-large", action="store_true",
                        help="scan files of a tree over the size limit, too, in pieces")
    parser.add_argument("--spread", action="store_true",
                        help="shuffle a table of few files by path before the scan")
    parser.add_argument("--custom-patterns", metavar="FILE")
    parser.add_argument("--baseline", metavar="PATH", help="earlier JSON report")
    parser.add_argument("--allow-unscanned", action="store_true",
                        help="exit normally though some files could not be scanned")
    parser.add_argument("--output", metavar="DIR", required=True)
    parser.add_argument("--output-format", choices=[*FORMATS, "all"], default="json")
    parser.add_argument("--single-files", action="store_true",
                        help="write each report as one file instead of a folder of parts")
    parser.add_argument("--fail-on-high", action="store_true")
    return parser.parse_args(argv)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args, reading = _arguments(argv), None
    spark = spark or SparkSession.builder.appName("keysift").getOrCreate()
    options = ScanOptions.from_env()
    if args.max_depth is not None:
        options = options.with_(max_depth=args.max_depth)
    if args.local:
        root = args.local
        if "://" not in root:
            root = os.path.abspath(os.path.expanduser(root))
        listing = list_tree(spark, root, options.max_depth, options.skip_fragments)
        # Labels come first: they decide what --repos keeps and what --blame belongs to.
        labels = label_repos(listing.where("NOT is_dir").select("path"), tree_roots(listing))
        owner = F.when(F.coalesce("repo_root", F.lit("")) != "", F.col("repo_root"))
        labels = materialize(labels.select(
            "path", F.coalesce(owner, F.lit("local")).alias("repo")), "labels")
        wanted = listing.join(labels, "path", "left")
        if args.repos:
            wanted = active_only(wanted, spark.read.parquet(args.repos))
        files = scan_tree(spark, root, options, listing=wanted)
        problems = unscanned(listing, options)
        large = over_limit(wanted, options) if args.scan_large else None
        # Counted while the scan reads them; the usual scan has none and reads nothing twice.
        reading, whole = Observation(), files
        files = files.observe(reading, F.count_if(F.col("content").isNull()).alias("unread"))
    else:
        # The depth limit is a rule for local trees only.
        table = spark.read.parquet(args.table).select("repo", "path", "content")
        if args.spread:
            table = table.repartition("path")
        files = within_limits(
            from_table(table, F.col("repo"), F.col("path"), F.col("content")),
            options.with_(max_depth=args.max_depth))
        problems = table.where(
            F.octet_length("content") > options.max_file_size_mb * 1024 * 1024).select(
            "path", F.lit("too large").alias("reason"))
        # No size rule drops a row without content.
        unread = within_limits(
            table.where("content IS NULL").select("repo", "path", F.lit(0).alias("size")),
            options.with_(max_depth=args.max_depth))
        if args.repos:
            repos = spark.read.parquet(args.repos)
            files, unread = active_only(files, repos), active_only(unread, repos)
        problems = problems.unionByName(
            unread.select("path", F.lit("cannot be read").alias("reason")))
    custom = load_custom_patterns(spark, args.custom_patterns) if args.custom_patterns else []
    baseline = blame = None
    known = args.baseline or (options.baseline_path if options.incremental else None)
    if known:
        options = options.with_(incremental=True)
        baseline = baselines.read_baseline(spark, known)
    if args.blame:
        options = options.with_(attach_blame=True)
        blame = parse_porcelain(spark.read.parquet(args.blame))
    more = None
    if args.local and large is not None:
        pieces = read_pieces(spark, root, large)
        more = detect_in_pieces(pieces, options, custom)
        unread = pieces.where("content IS NULL").select("path", F.lit("cannot be read").alias("reason"))
        problems = problems.where("reason != 'too large'").unionByName(unread)
    findings = scan(files, options, custom, baseline, blame, more=more)
    formats = FORMATS if args.output_format == "all" else [args.output_format]
    write = write_documents if args.single_files else write_reports
    summary = write(findings, args.output, options, formats,
                    described={c.name: c.description for c in custom})
    if reading is not None and reading.get["unread"]:
        again = unscanned(listing, options, whole)
        problems = again if more is None else again.where("reason != 'too large'").unionByName(unread)
    problems.write.json(f"{args.output}/unscanned.json")
    counted = {r["reason"]: r["n"] for r in spark.read.schema("path STRING, reason STRING").json(
        f"{args.output}/unscanned.json").groupBy("reason").agg(F.count("*").alias("n")).orderBy(
        F.desc("n")).limit(_SHOWN + 1).collect()}
    levels = summary["by_risk_level"]
    print(f"{levels['high_risk']} high-risk, {levels['medium_risk']} medium-risk, "
          f"{levels['low_risk']} low-risk")
    left_out = list(counted.items())
    if left_out:
        print("not scanned: " + ", ".join(f"{n} {reason}" for reason, n in left_out[:_SHOWN])
              + (", and for further reasons" if len(left_out) > _SHOWN else ""))
    if args.fail_on_high and levels["high_risk"] > 0:
        return 1
    return 2 if left_out and not args.allow_unscanned else 0


if __name__ == "__main__":
    sys.exit(main())
