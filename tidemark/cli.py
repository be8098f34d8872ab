"""Command line: list what there is, or run a pipeline from files to files.

    python -m tidemark.cli list-methods s1
    python -m tidemark.cli replay --cache rows.parquet --out results --schemes equal_weight roll_sr_cap10
    python -m tidemark.cli run --preset P-1 --prices prices.parquet --pairs pairs.parquet --out results --set fee=0.0005

Exit codes: 0 done, 1 a strict anomaly check failed, 2 wrong arguments.
"""

from __future__ import annotations

import argparse
import datetime
import json
import sys
from collections.abc import Sequence
from typing import Any

from .operators import pipeline as PL, replay as RP, signals
from .sources.shared import Files


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("list-stages")
    sub.add_parser("list-methods").add_argument("stage", choices=PL.STAGES)
    sub.add_parser("list-signals")
    sub.add_parser("list-presets")
    sub.add_parser("list-schemes")
    run = sub.add_parser("run")
    run.add_argument("--preset", choices=sorted(PL.PRESETS), required=True)
    run.add_argument("--prices", required=True, help="Parquet: ticker, ts, close")
    run.add_argument("--pairs", required=True, help="Parquet: pair, numerator, denominator")
    run.add_argument("--out", required=True)
    run.add_argument("--stop-after", choices=PL.STAGES[1:])
    run.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
    run.add_argument("--policy", choices=("off", "warn", "strict"), default="warn")
    replay = sub.add_parser("replay")
    replay.add_argument("--cache", required=True, help="Parquet: ticker, ts, close, low, atr, pos_raw, stop_code, stop_param")
    replay.add_argument("--out", required=True)
    replay.add_argument("--schemes", nargs="*", help="all 59 without")
    replay.add_argument("--cap", choices=RP.CAPS, help="of the schemes with caps only these")
    replay.add_argument("--seed", type=float, default=100_000.0)
    replay.add_argument("--rule", choices=RP.SIZING)
    replay.add_argument("--commission", default=RP.COMMISSION)
    replay.add_argument("--bench", help="Parquet: ts, equity")
    replay.add_argument("--start", help="first out-of-sample day, with --bench")
    return top


def replay(args: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    names = RP.filter_schemes(args.schemes or RP.scheme_names(), args.cap)
    for name in names:
        RP.parse_scheme(name)
    rules = {"model": args.commission} | ({"rule": args.rule} if args.rule else {})
    RP.save_replay(spark.read.parquet(args.cache), names, args.out, args.seed, **rules)
    if args.bench:
        days, counts = (RP.load_replay(spark, args.out, o) for o in ("days", "counts"))
        rows = RP.summary_rows(days, counts, spark.read.parquet(args.bench), args.start, args.seed)
        rows.write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/summary")
    return 0


def settings(given: Sequence[str]) -> dict[str, Any]:
    """NAME=VALUE settings; values are JSON."""
    out = {}
    for item in given:
        name, equals, value = item.partition("=")
        if not equals or PL.SETTING.get(name, name) not in PL.CONFIG:
            raise ValueError(f"no setting {item!r}; there are {', '.join(sorted(PL.CONFIG))}")
        out[name] = json.loads(value)
    return out


def run(args: argparse.Namespace, config: dict[str, Any]) -> int:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    made = PL.Pipeline(name=args.preset, **PL.PRESETS[args.preset])
    if made.s2 in ("grid_breakout", "grid_obv_pivot"):
        print(f"{args.preset} needs bars; run it from Python", file=sys.stderr)
        return 2
    result = made.run(spark.read.parquet(args.prices), spark.read.parquet(args.pairs), config, args.stop_after)
    tag, failed = PL.build_tag(config), False
    # What ran, defaults included, for whoever repeats it.
    at = datetime.datetime.now().strftime("%Y%m%dT%H%M%S")
    Files(spark, args.out).write_json(f"{'_'.join(x for x in ('run', at, tag) if x)}.json", {"meta": {"timestamp": at, "tag": tag, "preset": args.preset}, "config": result.config})
    for stage, df in result.stages.items():
        path = f"{args.out.rstrip('/')}/{PL.stage_name(stage, None, tag)}.parquet"
        df.write.mode("overwrite").parquet(path)
        if args.policy != "off" and stage != "s5":
            bad = PL.anomalies(spark.read.parquet(path), stage, args.policy).filter("not ok").collect()  # a row per check
            for r in bad:
                print(f"{r['severity']}: {r['check']} is {r['value']}, outside {r['low']} to {r['high']}", file=sys.stderr)
            failed = failed or (args.policy == "strict" and bool(bad))
    for name, weights in result.final.items():
        weights.write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/weights_{name}.parquet")
    return int(failed)


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "replay":
        if args.bench and not args.start:
            print("--bench needs --start", file=sys.stderr)
            return 2
        try:
            return replay(args)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
    if args.command == "run":
        try:
            config = settings(args.set)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
        return run(args, config)
    listed = {"list-stages": lambda: PL.STAGES, "list-methods": lambda: sorted(PL.REGISTRY[args.stage]), "list-signals": lambda: sorted(signals.SIGNALS), "list-presets": lambda: [f"{k} {json.dumps(v)}" for k, v in PL.PRESETS.items()], "list-schemes": RP.scheme_names}
    print("\n".join(listed[args.command]()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
