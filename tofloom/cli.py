"""Command line: ``python -m tofloom.cli reduce|watch|extract-gdc|stream``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import config
from .plans import pipeline
from .sources import sinks
from .streaming import live


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tofloom")
    sub = top.add_subparsers(dest="command", required=True)
    r = sub.add_parser("reduce", help="raw files to hits, neutrons, TOF images and spectrum")
    r.add_argument("-i", "--input", required=True)
    r.add_argument("-H", "--hits")
    r.add_argument("-E", "--events")
    r.add_argument("-u", "--config")
    r.add_argument("-T", "--tiff")
    r.add_argument("-f", "--base", default="tof_image")
    r.add_argument("-m", "--mode", default="neutron")
    r.add_argument("-t", "--timing", default="tdc")
    r.add_argument("-s", "--spectra")
    r.add_argument("-c", "--chunk-size", type=int, default=5 << 30)
    w = sub.add_parser("watch", help="reduce the files of a folder as they come")
    w.add_argument("-i", "--input", required=True)
    w.add_argument("-o", "--output", required=True)
    w.add_argument("-u", "--config")
    w.add_argument("-f", "--base", default="tof_image")
    w.add_argument("-m", "--mode", default="neutron")
    w.add_argument("-c", "--interval", type=float, default=5.0)
    g = sub.add_parser("extract-gdc", help="global-clock records as CSV")
    g.add_argument("-i", "--input", required=True)
    g.add_argument("-o", "--output", required=True)
    g.add_argument("-c", "--chunk-size", type=int, default=5 << 30)
    s = sub.add_parser("stream", help="cluster a growing folder")
    s.add_argument("input")
    s.add_argument("-o", "--output", default="events_streamed")
    s.add_argument("--checkpoint", default="checkpoints/stream")
    for p in (r, w, g, s):
        p.add_argument("-d", "--debug", action="store_true")
        p.add_argument("-v", "--verbose", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "reduce":
        config.check_options(mode=args.mode, timing=args.timing, chunk_size=args.chunk_size, inputs=(args.input, *([args.config] if args.config else [])))
    elif args.command == "watch":
        config.check_options(mode=args.mode, interval=args.interval, inputs=(args.input,))
    elif args.command == "extract-gdc":
        config.check_options(chunk_size=args.chunk_size, inputs=(args.input,))
    spark = spark or SparkSession.builder.appName("tofloom").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if args.verbose or args.debug else "WARN")
    if args.command == "reduce":
        done = pipeline.run_reduce(
            spark, args.input, hits=args.hits, neutrons=args.events, tiff=args.tiff, base=args.base, spectra=args.spectra,
            config=config.load(args.config), mode=args.mode, timing=args.timing, chunk_size=args.chunk_size,
        )
        print("\n".join(f"{k}: {v}" for k, v in done.items()))
    elif args.command == "watch":
        live.watch(spark, args.input, args.output, args.interval, base=args.base, mode=args.mode, config=config.load(args.config))
    elif args.command == "extract-gdc":
        sinks.gdc_csv(pipeline.extract_gdc(spark, args.input), args.output)
    else:
        live.cluster_stream(live.packet_stream(spark, args.input), args.output, args.checkpoint).awaitTermination()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
