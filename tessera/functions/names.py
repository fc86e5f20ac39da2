"""Scene names carry keys: the panchromatic partner, layouts on disk, exclusions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(file: Column) -> Column:
    """A file name without its three-letter suffix."""
    return F.substring(file, 1, F.greatest(F.length(file) - 4, F.lit(0)))


def scene_key(name: Column, first_letter: str = "a") -> Column:
    """Eight characters from the first ``first_letter`` on."""
    return F.substring(name, 0, 0) if first_letter == "" else F.when(F.instr(name, first_letter) > 0, name.substr(F.instr(name, first_letter), F.lit(8)))


def pan_key(key: Column) -> Column:
    """The partner of a multispectral key: its digits from the first 0 plus one, seven places."""
    digits = F.regexp_extract(key, r"0\d*", 0)
    return F.when(digits != "", F.concat(F.upper(F.substring(key, 1, 1)), F.lpad((digits.cast("long") + 1).cast("string"), 7, "0")))


def pan_paths(folder: str, name: Column) -> Column:
    """Where a panchromatic scene may lie, best first: as written, upper and lower case, each in the
    sensor's layout and then as a plain file."""
    paths = []
    for n in (name, F.upper(name), F.lower(name)):
        paths += [F.concat(F.lit(f"{folder}/"), n, F.lit("/"), n, F.lit("_B1.DAT.raw")), F.concat(F.lit(f"{folder}/"), n, F.lit(".tif"))]
    return F.array(*paths)
