"""Explicit schemas of every table; nothing is inferred at read time."""

from __future__ import annotations

RING_WIDTH = "rwl STRING, tree STRING, year INT, width DOUBLE"

SITE_METADATA = (
    "rwl STRING, first_year INT, last_year INT, country STRING, latitude DOUBLE, "
    "longitude DOUBLE, elevation DOUBLE, species_code STRING, species_name STRING"
)

TREE_AGE = (
    "rwl STRING, tree STRING, first INT, last INT, age INT, mean_growth DOUBLE, "
    "growth_sd DOUBLE, ar1 DOUBLE, rwl_meanage DOUBLE, rwl_totage INT, flag STRING"
)

CHRONOLOGY = "rwl STRING, year INT, std DOUBLE, samp_depth BIGINT"
BAI = "rwl STRING, tree STRING, year INT, bai DOUBLE"
FLAGS = "rwl STRING, flag STRING"
INTERSERIES_TREE = "rwl STRING, tree STRING, res_cor DOUBLE, p_val DOUBLE"

GRID_MONTHLY = "variable STRING, row INT, col INT, layer INT, value DOUBLE"
GRID_STATIC = "layer STRING, row INT, col INT, value DOUBLE"
CLIMATE_POINTS = (
    "lon DOUBLE, lat DOUBLE, climate STRING, main_climate STRING, mainc_code DOUBLE, kg DOUBLE"
)

CLIMATE_LONG = "rwl STRING, year INT, month INT, pre DOUBLE, tmp DOUBLE, tmn DOUBLE, tmx DOUBLE"
SPEI_LONG = "rwl STRING, year INT, month INT, spei DOUBLE"
CLIMATE_COEF = (
    "rwl STRING, window STRING, id INT, varname STRING, month STRING, month_order INT, "
    "coef DOUBLE, significant BOOLEAN, ci_lower DOUBLE, ci_upper DOUBLE"
)

_VARIABLES = "ARRAY<STRUCT<cvWhat: STRING, cvUnit: STRING>>"
_DATA_FILE = (
    "ARRAY<STRUCT<linkText: STRING, urlDescription: STRING, fileUrl: STRING, "
    f"variables: {_VARIABLES}>>"
)
_PALEO_DATA = (
    "ARRAY<STRUCT<timeUnit: STRING, "
    "species: ARRAY<STRUCT<speciesCode: STRING, scientificName: STRING>>, "
    f"dataFile: {_DATA_FILE}>>"
)
_GEO = (
    "STRUCT<geometry: STRUCT<coordinates: ARRAY<STRING>>, "
    "properties: STRUCT<minElevationMeters: STRING>>"
)
_SITE = (
    "ARRAY<STRUCT<NOAASiteId: STRING, siteName: STRING, locationName: STRING, "
    f"geo: {_GEO}, paleoData: {_PALEO_DATA}>>"
)
_STUDY_FIELDS = (
    "NOAAStudyId: STRING, studyName: STRING, studyCode: STRING, investigators: STRING, "
    "doi: STRING, contributionDate: DATE, onlineResourceLink: STRING, earliestYearCE: INT, "
    f"mostRecentYearCE: INT, publication: ARRAY<STRUCT<citation: STRING>>, site: {_SITE}"
)
STUDY = f"STRUCT<{_STUDY_FIELDS}>"
# A search response is one document that wraps the list of studies.
CATALOGUE_DOCUMENT = f"STRUCT<study: ARRAY<{STUDY}>>"
