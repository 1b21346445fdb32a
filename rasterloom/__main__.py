"""Command line: python -m rasterloom raster|query|stats|info|convert|migrate SOURCE ..."""

from __future__ import annotations

import argparse
import json
import sys

from .session import local_session
from .sources.catalog import CatalogSchemaError, migrate, open_catalog
from .sources.geotiff import build_catalog


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="rasterloom", description=__doc__)
    sub = p.add_subparsers(dest="verb", required=True)
    for verb in ("raster", "query", "stats", "info", "convert", "migrate"):
        s = sub.add_parser(verb)
        s.add_argument("source")
        if verb == "query":
            s.add_argument("--bbox", type=float, nargs=4)
            s.add_argument("--crs", default=None)
            s.add_argument("--start")
            s.add_argument("--end")
        if verb == "info":
            s.add_argument("--row", type=int, default=0)
        if verb == "raster":
            s.add_argument("--pattern", default="")
            s.add_argument("--crs", default=None)
        if verb in ("raster", "convert", "migrate"):
            s.add_argument("--out", required=True)
        if verb == "convert":
            s.add_argument("--partition-by", nargs="*", default=None)
        if verb == "migrate":
            s.add_argument("--to-version", type=int, default=0)
    a = p.parse_args(argv)
    spark = local_session(4)
    try:
        if a.verb == "migrate":
            migrate(spark, a.source, a.out, to_version=a.to_version)
            return 0
        if a.verb == "raster":
            built = build_catalog(spark, a.source, a.pattern, crs=a.crs)
            built.write(a.out)
            print(json.dumps({"out": a.out, "n": built.count()}))
            return 0
        c = open_catalog(spark, a.source)
        if a.verb == "query":
            time = (a.start or "1900-01-01", a.end or "2100-01-01") if a.start or a.end else None
            out = {"n": c.query(bounds=a.bbox, crs=a.crs, time=time).count()}
        elif a.verb == "stats":
            out = {**c.config(), **c.stats().first().asDict()}
        elif a.verb == "info":
            rows = c.row(a.row).collect()
            out = rows[0].asDict() if rows else None
        else:
            c.write(a.out, partition_by=a.partition_by)
            out = {"out": a.out}
        print(json.dumps(out, default=str))
        return 0
    except CatalogSchemaError as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
