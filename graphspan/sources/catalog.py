"""Graphs by name: meshes, files of a folder, and what is derived from them.

A name is resolved from its end: `-lcc` is the largest component over dense ids, `-rweight` random
weights, `-xN` N layers; what is left names a mesh or a file.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from graphspan.operators import transforms
from graphspan.sources import graphs

#: fixed values: names of graphs, by the format of their files, and the file of each
SNAP = {
    "friendster": "com-friendster.ungraph.txt.gz",
    "facebook": "facebook_combined.txt.gz",
    "twitter": "twitter_combined.txt.gz",
    "livejournal": "soc-LiveJournal1.txt.gz",
    "orkut": "com-orkut.ungraph.txt.gz",
}
ROADS = {
    "colorado": "USA-road-d.COL.gr.gz",
    "USA": "USA-road-d.USA.gr.gz",
    "USA-CTR": "USA-road-d.CTR.gr.gz",
    "USA-W": "USA-road-d.W.gr.gz",
    "USA-E": "USA-road-d.E.gr.gz",
    "rome": "rome99.gr",
    "ny": "USA-road-d.NY.gr.gz",
}
#: fixed values: web graphs, expected as Parquet edge tables of these names
WEB = ["clueweb12", "gsh-2015", "cnr-2000", "it-2004", "uk-2005", "sk-2005", "uk-2014-tpd", "uk-2014-host", "uk-2007-05-small", "twitter-2010"]
#: fixed values: parameters of the weighted meshes and seeds
MESH_SEED, WEIGHT_SEED, HEAVY, SHARE = 4361356, 13451845, 1_000_000, 0.1


def resolve(spark: SparkSession, name: str, folder: str = ".") -> DataFrame:
    """The edges of a named graph; KeyError if there is none of that name. Files are read from folder."""
    if name.endswith("-lcc"):
        return transforms.remap(transforms.largest_component(resolve(spark, name.removesuffix("-lcc"), folder)))
    if name.endswith("-rweight"):
        return transforms.random_weights(resolve(spark, name.removesuffix("-rweight"), folder), WEIGHT_SEED)
    if found := re.fullmatch(r"(.+)-x(\d+)", name):
        return transforms.layered(resolve(spark, found[1], folder), int(found[2]))
    if found := re.fullmatch(r"mesh-(biw-|rw-)?(\d+)", name):
        side = int(found[2])
        if found[1] == "biw-":
            return graphs.mesh_two_weights(spark, side, SHARE, HEAVY, 1, MESH_SEED)
        return graphs.mesh_random_weights(spark, side, 1, HEAVY, MESH_SEED) if found[1] else graphs.mesh(spark, side)
    if name in SNAP:
        return graphs.read_edge_list(spark, f"{folder}/{SNAP[name]}")
    if name in ROADS:
        return graphs.read_road_network(spark, f"{folder}/{ROADS[name]}")
    if name in WEB:
        return graphs.read_edge_table(spark, f"{folder}/{name}")
    raise KeyError(name)


def names() -> list[str]:
    """Every base name and its largest component, and the names derived with weights and layers."""
    meshes = ["mesh-10", "mesh-100", "mesh-1000", "mesh-2048", "mesh-biw-1000", "mesh-biw-2048", "mesh-rw-1000", "mesh-rw-2048"]
    base = [*meshes, *WEB, *SNAP, *ROADS]
    return [*base, *(f"{x}-lcc" for x in base), "sk-2005-lcc-rweight", "twitter-2010-lcc-rweight", *(f"USA-x{n}" for n in (2, 4, 5, 6, 8, 10, 12))]
