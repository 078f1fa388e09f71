"""python -m driftgrove baseline | timeline | from-csv | serve ..."""

from __future__ import annotations

import argparse
import http.server
import re

from pyspark.sql import SparkSession

from driftgrove.config import Config
from driftgrove.engine import Engine, save_json
from driftgrove.sources import batches, timeline


#: Where a tree is served: by this name, and by one word before it as older clients ask.
ROUTE = re.compile("/([a-z]+-)?tree")


def serve(path: str, port: int) -> None:
    """Answers GET with the file on ROUTE."""
    with open(path, "rb") as f:
        body = f.read()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            found = ROUTE.fullmatch(self.path.split("?")[0])
            self.send_response(200 if found else 404)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            self.wfile.write(body if found else b"{}")

    http.server.ThreadingHTTPServer(("0.0.0.0", port), Handler).serve_forever()


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="driftgrove")
    sub = p.add_subparsers(dest="command", required=True)
    base = sub.add_parser("baseline", help="a tree from a JSON batch")
    base.add_argument("batch")
    for name in ("--config", "--snapshot-out", "--dump-tree", "--dump-tree-verbose"):
        base.add_argument(name)
    base.add_argument("--print", action="store_true", dest="show")
    line = sub.add_parser("timeline", help="a tree per chunk of a JSON batch")
    line.add_argument("batch")
    line.add_argument("directory")
    line.add_argument("--config")
    line.add_argument("--chunks", type=int, default=8)
    line.add_argument("--chunk-size", type=int)
    line.add_argument("--clean", action="store_true")
    csv = sub.add_parser("from-csv", help="a JSON batch from a CSV table")
    csv.add_argument("table")
    csv.add_argument("out")
    csv.add_argument("--batch-index", type=int, default=0)
    csv.add_argument("--min-tokens", type=int, default=1)
    csv.add_argument("--lines", action="store_true", help="a folder of JSON lines, written by the executors, instead of one file")
    web = sub.add_parser("serve", help="a verbose tree over HTTP")
    web.add_argument("tree")
    web.add_argument("--port", type=int, default=8000)
    o = p.parse_args(args)
    if o.command == "serve":
        serve(o.tree, o.port)
        return 0
    spark = SparkSession.builder.appName("driftgrove").getOrCreate()
    if o.command == "from-csv":
        rows = batches.csv_sources(batches.csv_rows(batches.read_csv(spark, o.table)), "__row", o.batch_index, o.min_tokens)
        batches.write_lines(rows, o.out) if o.lines else batches.write_batch_json(rows, o.out)
        return 0
    engine = Engine(spark, Config.load(o.config) if o.config else Config())
    sources = batches.read_batch(spark, o.batch)
    if o.command == "timeline":
        chunks = batches.chunks_of_size(sources.count(), o.chunk_size) if o.chunk_size else o.chunks
        print(timeline.write_timeline(engine, sources, o.directory, chunks, o.clean))
        return 0
    first = sources.agg({"batch_index": "min"}).first()[0]
    print(engine.build_baseline(sources, first or 0))
    tree = engine.tree()
    if o.snapshot_out:
        save_json(engine.snapshot(), o.snapshot_out)
    if o.dump_tree:
        save_json(tree.plain(), o.dump_tree)
    if o.dump_tree_verbose:
        save_json(tree.verbose(), o.dump_tree_verbose)
    if o.show:
        print(tree.outline())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
