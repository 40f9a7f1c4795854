"""python -m weftline CONFIG FRAMES OUT: reads <FRAMES>/*_<id>.txt and writes graphs, similarities and layouts below OUT."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import config as configuration
from .operators.frames import first_dimensions
from .plans import pipeline
from .sources import text as files


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="weftline", description=__doc__)
    parser.add_argument("config", help="JSON file of settings")
    parser.add_argument("frames", help="folder of frame files")
    parser.add_argument("out", help="folder for the results; what it holds under the same names is replaced")
    parser.add_argument("--kernel", choices=["cosine", "rbf", "laplacian"], default="cosine")
    parser.add_argument("--sample", type=int, help="walk steps an item instead of exact profiles")
    parser.add_argument("--plain-steps", type=int, default=pipeline.descent.PLAIN_STEPS)
    parser.add_argument("--joint-steps", type=int, default=pipeline.descent.JOINT_STEPS)
    given = parser.parse_args(argv)
    settings = configuration.load(given.config)
    spark = SparkSession.builder.appName(f"weftline {settings.data_name}").getOrCreate()
    frames = pipeline.write_table(files.read_frames(spark, f"{given.frames}/*.txt", list(settings.frame_ids)), "frames")
    configuration.check(frames, settings)
    frames = first_dimensions(frames, dict(zip(settings.frame_ids, settings.dims, strict=True))) if settings.dims else frames
    got = pipeline.analyse(spark, frames, settings, given.sample, given.kernel, plain_steps=given.plain_steps, joint_steps=given.joint_steps)
    files.write_graph(got.graphs, frames, f"{given.out}/graphs")
    files.write_similarities(got.similarities, f"{given.out}/similarities")
    files.write_layouts(got.layouts, f"{given.out}/layouts")


if __name__ == "__main__":
    main()
