"""python -m helixframe audit|batch|evidence|sites: runs from files to tables, in the session that spark-submit gives or a local one."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from helixframe.plans import run


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="helixframe")
    kinds = top.add_subparsers(dest="run", required=True)

    def add(name: str, *names: str) -> argparse.ArgumentParser:
        p = kinds.add_parser(name)
        for n in names:
            p.add_argument(f"--{n}", required=True)
        p.add_argument("--reference", nargs="+", required=True)
        p.add_argument("--out", required=True)
        return p

    for p in (add("audit", "edited", "starter"), add("batch", "manifest", "starter")):
        p.add_argument("--intended")
        p.add_argument("--guide")
        p.add_argument("--pam", help="the editor's usual one if it isn't given")
        p.add_argument("--editor", default="cas9")
        p.add_argument("--mismatches", type=int, default=4)
        p.add_argument("--within", type=int, default=50)
        p.add_argument("--annotation", help="a GenBank file; one beside the reference if it isn't given")
        p.add_argument("--hypothesis", action="store_true")
        p.add_argument("--version", type=int, choices=(1, 2), default=2)
    add("evidence", "sam")
    p = add("sites", "guide")
    p.add_argument("--pam", default="NGG")
    p.add_argument("--mismatches", type=int, default=4)
    return top


def main(args: list[str] | None = None) -> None:
    given = vars(parser().parse_args(args))
    kind = given.pop("run")
    getattr(run, f"run_{kind}")(SparkSession.builder.appName(f"helixframe {kind}").getOrCreate(), **given)


if __name__ == "__main__":
    main()
