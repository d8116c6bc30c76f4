"""python -m rastrel IMAGE [OUT] [-q draft|balanced|high|max]: convert one image file and print its measures."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans.convert import convert
from .sources.pixels import decode_images, fit_inside, unpack_images

WORK_SIDE = {"draft": 256, "balanced": 320, "high": 384, "max": 448}


def main() -> None:
    parse = argparse.ArgumentParser(prog="rastrel", description=__doc__)
    parse.add_argument("image")
    parse.add_argument("out", nargs="?")
    parse.add_argument("-q", "--quality", choices=sorted(WORK_SIDE), default="balanced")
    parse.add_argument("--budget", type=int, help="refinement steps instead of the tier's")
    a = parse.parse_args()
    spark = SparkSession.builder.appName("rastrel").getOrCreate()
    image = decode_images(spark, a.image).withColumn("img_id", F.lit(0).cast("long"))
    row = convert(unpack_images(fit_inside(image, WORK_SIDE[a.quality])), a.quality, a.budget).first()
    out = Path(a.out or Path(a.image).with_suffix(".svg").name)
    out.write_text(row["svg"])
    print(f"{out}: {row['type']}, {row['candidate']}, error {row['base_score']:.4f} -> {row['score']:.4f}, {row['shapes']} shapes, {row['bytes']} bytes")


if __name__ == "__main__":
    main()
