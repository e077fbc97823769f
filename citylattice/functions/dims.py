"""Fixed values of the domain: class lists, code maps, priorities, albedo, materials, sky bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Voxel codes and materials.
GROUND, TREE, BUILDING, AIR = -1, -2, -3, 0
MATERIALS = {"unknown": -3, "brick": -11, "wood": -12, "concrete": -13, "metal": -14, "stone": -15, "glass": -16, "plaster": -17}
LANDMARK = -30
TRUNK_RATIO = 11.76 / 19.98

# Standard land-cover classes 1..14.
STANDARD = ["Bareland", "Rangeland", "Shrub", "Agriculture land", "Tree", "Moss and lichen", "Wet land", "Mangrove", "Water", "Snow and ice", "Developed space", "Road", "Building", "No Data"]

# Standard code of each source's class index, in order of the index.
TO_STANDARD = {
    "Urbanwatch": [13, 12, 11, 5, 2, 4, 9, 1, 14, 9],
    "ESA WorldCover": [5, 3, 2, 4, 11, 1, 10, 9, 7, 8, 6],
    "ESRI 10m Annual Land Cover": [14, 9, 5, 2, 7, 4, 3, 11, 1, 10, 14],
    "Dynamic World V1": [9, 5, 2, 7, 4, 3, 11, 1, 10],
    "OpenEarthMapJapan": [1, 2, 11, 12, 5, 9, 4, 13, 14],
}

# Colours and names of the Standard and OpenStreetMap palette, in order of the index.
PALETTE = [
    (128, 0, 0, "Bareland"), (0, 255, 36, "Rangeland"), (255, 224, 80, "Shrub"), (255, 255, 0, "Moss and lichen"), (75, 181, 73, "Agriculture land"), (34, 97, 38, "Tree"), (0, 236, 230, "Wet land"),
    (22, 61, 51, "Mangroves"), (0, 69, 255, "Water"), (192, 192, 255, "Snow and ice"), (148, 148, 148, "Developed space"), (255, 255, 255, "Road"), (222, 31, 7, "Building"), (0, 0, 0, "No Data"),
]

# Paint priority of OpenStreetMap classes; the least number is painted last and wins.
PRIORITY = {"Building": 2, "Road": 1, "Developed space": 13, "Water": 3, "Wet land": 4, "Moss and lichen": 5, "Mangrove": 6, "Tree": 12, "Agriculture land": 11, "Shrub": 10, "Rangeland": 9, "Snow and ice": 8, "Bareland": 7, "No Data": 14}

# Albedo by 0-based land-cover class; anything else counts as developed.
ALBEDO = [0.20, 0.25, 0.20, 0.20, 0.15, 0.12, 0.12, 0.06, 0.80, 0.20, 0.12, 0.20]
ALBEDO_OTHER = 0.20

# Tregenza bands as (upper elevation, patches, elevation of the centre).
TREGENZA = [(12.0, 30, 6.0), (24.0, 30, 18.0), (36.0, 24, 30.0), (48.0, 24, 42.0), (60.0, 18, 54.0), (72.0, 12, 66.0), (84.0, 6, 78.0), (90.0, 1, 90.0)]


def class_map(spark: SparkSession) -> DataFrame:
    """(source, idx, code): a few dozen rows."""
    return spark.createDataFrame([(s, i, c) for s, codes in TO_STANDARD.items() for i, c in enumerate(codes)], "source string, idx int, code int")


def palette(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(PALETTE)], "idx int, r int, g int, b int, name string")


def priorities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, PRIORITY.get(n, 15)) for i, (_, _, _, n) in enumerate(PALETTE)], "idx int, name string, priority int")
