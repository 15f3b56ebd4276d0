"""python -m lodestar.cli stats|tags|doctor|rebuild HOME [ROOT] [--sig SIG] [--url URL --model MODEL --dimension N]: exit 0
when all is well, 1 on findings, 2 on misuse."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestar.operators import audit
from lodestar.plans import build
from lodestar.session import ship
from lodestar.sources import diaries, store


def _there(spark: SparkSession, path: str) -> bool:
    fs, p, _ = store._hadoop(spark, path)
    return fs.exists(p)


def main(args: list[str] | None = None, spark: SparkSession | None = None, embed: build.Embed | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestar")
    parser.add_argument("command", choices=["stats", "tags", "doctor", "rebuild"])
    parser.add_argument("home")
    parser.add_argument("root", nargs="?")
    parser.add_argument("--sig")
    parser.add_argument("--url")
    parser.add_argument("--model")
    parser.add_argument("--dimension", type=int)
    try:
        given = parser.parse_args(args)
    except SystemExit:
        return 2
    spark = ship(spark or SparkSession.builder.appName("lodestar").getOrCreate())
    known = store.current(spark, given.home)
    wrong = None
    if given.command != "tags" and not given.root:
        wrong = "ROOT is needed"
    elif given.command != "tags" and not _there(spark, given.root):
        wrong = f"no folder at {given.root}"
    elif given.command == "rebuild" and embed is None and not (given.url and given.model and given.dimension):
        wrong = "--url, --model and --dimension are needed"
    elif given.command != "rebuild" and known is None:
        wrong = f"no index at {given.home}"
    if wrong:
        print(wrong, file=sys.stderr)
        return 2
    if given.command == "rebuild":
        sig = given.sig or f"{given.model}@{given.dimension}"
        embed = embed or diaries.http_embedder(given.url, given.model, given.dimension)
        generation = build.rebuild(spark, given.root, given.home, embed, sig)
        files, chunks = (store.load(spark, given.home, name, sig).count() for name in ("manifest", "chunks"))
        print(f"generation {generation}: {files} files, {chunks} chunks")
        return 0
    tags = store.load(spark, given.home, "tags", known[1])
    if given.command == "tags":
        rows = audit.tag_usage(store.load(spark, given.home, "occurrences", known[1]), tags).orderBy(F.desc("occurrences"), "name")
        for r in rows.toLocalIterator():  # all of them, a partition at a time
            print(f"{r['name']}\t{r['occurrences']}\t{r['files']}\t{'vector' if r['vectorized'] else 'no vector'}")
        return 0
    if given.command == "stats":
        print(f"signature {known[1]}, generation {known[0]}, axes {'trained' if store.holds(spark, given.home, 'axes') else 'not trained'}")
        audit.store_stats(diaries.read_diaries(spark, given.root), store.load(spark, given.home, "chunks", known[1]), tags).show()
        return 0
    found = build.health(spark, given.root, given.home, given.sig or known[1])
    found.show(truncate=False)
    return int(not found.filter("not ok").isEmpty())


if __name__ == "__main__":
    sys.exit(main())
