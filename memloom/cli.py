"""``python -m memloom.cli VERB --log PATH ...``: audits and erasure from a shell."""

from __future__ import annotations

import argparse
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from .engine import Engine


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="memloom")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb in ("describe", "taint", "forget"):
        v = verbs.add_parser(verb)
        v.add_argument("--log", required=True)
        if verb != "describe":
            v.add_argument("--record", required=True)
            v.add_argument("--namespace", required=True)
        if verb == "forget":
            v.add_argument("--hard", action="store_true")
            v.add_argument("--verify", action="store_true")
    a = p.parse_args(argv)
    engine = Engine(SparkSession.builder.getOrCreate(), a.log)
    if a.verb == "describe":
        engine.describe().show(1000, False)
    elif a.verb == "taint":
        engine.audit_taint(a.record, a.namespace).show(1000, False)
    else:
        engine.forget(a.record, a.namespace, datetime.now(UTC).replace(tzinfo=None), a.hard)
        if a.verify:
            engine.verify_forget(a.record).show(1, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
