"""Study catalogue: nested search results to site metadata and file lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium import schemas
from cambium.operators.skew import lookup_join

# Fixed values of the study selection and of the wanted data files.
NAME_PART = "ITRDB"
INCLUDED_LOCATION = "Continent>Europe"
EXCLUDED_LOCATION = "Continent>Europe>Eastern Europe>Russia"
NEWEST_YEAR, OLDEST_LAST_YEAR = 2026, 1900
RAW_DESCRIPTION = "Raw Measurements"
EXCLUDED_LINK = "-noaa"
RING_WIDTH_VARIABLE = "physical property>width>total ring width"


def read_catalogue(spark: SparkSession, path: str, one_document: bool = True, tolerant: bool = False) -> DataFrame:
    """Studies from a search response, or from JSON lines (one study each, splittable).

    ``tolerant`` takes documents whose fields vary in shape (``parse_variants``).
    """
    text = spark.read.text(path, wholetext=one_document)
    if tolerant:
        wrapped = F.col("value") if one_document else F.concat(F.lit('{"study":['), F.col("value"), F.lit("]}"))
        return parse_variants(text.select(wrapped.alias("value")), "value")
    if not one_document:
        return text.select(F.from_json("value", schemas.STUDY).alias("s")).select("s.*")
    return parse_documents(text, "value")


def parse_documents(documents: DataFrame, column: str) -> DataFrame:
    """Catalogue documents held in a text column to one row per study."""
    parsed = documents.select(F.from_json(column, schemas.CATALOGUE_DOCUMENT).alias("d"))
    return parsed.select(F.explode("d.study").alias("s")).select("s.*")


def _part(of: Column, path: str, kind: str) -> Column:
    """A field of a variant in the kind that is wanted, NULL where it is missing or is something else."""
    return F.try_variant_get(of, f"$.{path}", kind)


def _struct(of: Column, **kinds: str) -> Column:
    return F.struct(*[_part(of, name, kind).alias(name) for name, kind in kinds.items()])


def _variant_data_set(data: Column) -> Column:
    def data_file(file: Column) -> Column:
        variables = F.transform(_part(file, "variables", "array<variant>"), lambda v: _struct(v, cvWhat="string", cvUnit="string"))
        texts = [_part(file, name, "string").alias(name) for name in ("linkText", "urlDescription", "fileUrl")]
        return F.struct(*texts, variables.alias("variables"))

    species = F.transform(_part(data, "species", "array<variant>"), lambda s: _struct(s, speciesCode="string", scientificName="string"))
    files = F.transform(_part(data, "dataFile", "array<variant>"), data_file)
    return F.struct(_part(data, "timeUnit", "string").alias("timeUnit"), species.alias("species"), files.alias("dataFile"))


def _variant_site(site: Column) -> Column:
    coordinates = F.struct(_part(site, "geo.geometry.coordinates", "array<string>").alias("coordinates")).alias("geometry")
    elevation = F.struct(_part(site, "geo.properties.minElevationMeters", "string").alias("minElevationMeters")).alias("properties")
    data = F.transform(_part(site, "paleoData", "array<variant>"), _variant_data_set)
    texts = [_part(site, name, "string").alias(name) for name in ("NOAASiteId", "siteName", "locationName")]
    return F.struct(*texts, F.struct(coordinates, elevation).alias("geo"), data.alias("paleoData"))


# The fields of a study besides its publications and sites, with their kinds.
STUDY_FIELDS = {
    "NOAAStudyId": "string",
    "studyName": "string",
    "studyCode": "string",
    "investigators": "string",
    "doi": "string",
    "contributionDate": "date",
    "onlineResourceLink": "string",
    "earliestYearCE": "int",
    "mostRecentYearCE": "int",
}


def parse_variants(documents: DataFrame, column: str) -> DataFrame:
    """Catalogue documents of varying shape to one row per study, as ``parse_documents`` has them.

    Every field is taken by itself out of a VARIANT.  One that is missing or
    has another shape, like ``variables`` that are no list, is NULL and takes
    nothing else with it; fields that no one asks for stay in ``study``.  Text
    that is no JSON gives no study.
    """
    parsed = documents.select(F.try_parse_json(column).alias("d"))
    study = parsed.select(F.explode(_part(F.col("d"), "study", "array<variant>")).alias("study"))
    s = F.col("study")
    publications = F.transform(_part(s, "publication", "array<variant>"), lambda p: _struct(p, citation="string"))
    sites = F.transform(_part(s, "site", "array<variant>"), _variant_site)
    return study.select(
        *[_part(s, name, kind).alias(name) for name, kind in STUDY_FIELDS.items()], publications.alias("publication"), sites.alias("site"), "study"
    )


def explode_sites(studies: DataFrame) -> DataFrame:
    """One row per study and site, the grain of everything that follows."""
    study = [c for c in studies.columns if c != "site"]
    return studies.select(*study, F.explode("site").alias("_site")).select(*study, "_site.*")


def filter_catalogue(
    sites: DataFrame,
    name: str = NAME_PART,
    include: str = INCLUDED_LOCATION,
    exclude: str = EXCLUDED_LOCATION,
    newest: int = NEWEST_YEAR,
    oldest_last: int = OLDEST_LAST_YEAR,
) -> DataFrame:
    return sites.filter(
        F.col("studyName").contains(name)
        & F.col("locationName").contains(include)
        & ~F.col("locationName").contains(exclude)
        & (F.col("earliestYearCE") <= newest)
        & F.col("mostRecentYearCE").between(oldest_last, newest)
    )


def _coordinate(first: int, compat: bool) -> Column:
    """Latitude (first = 0) or longitude (first = 1) of a point or of a box."""
    c = F.col("geo.geometry.coordinates")

    def number(i: int) -> Column:
        return F.get(c, F.lit(i)).try_cast("double")

    low, high = number(2 * first), number(2 * first + 1)
    box = low if compat else (low + high) / 2
    return F.when(F.size(c) == 2, number(first)).when(F.size(c) >= 4, box)


def site_metadata(sites: DataFrame, compat: bool = False, all_data_sets: bool = False) -> DataFrame:
    """Site metadata as one projection, study and site stay on the same row.

    ``compat`` takes the first edge of a coordinate box instead of its middle.
    """
    data = F.col("paleoData")
    species = F.flatten(F.transform(data, lambda d: d["species"])) if all_data_sets else F.get(data, F.lit(0))["species"]
    return sites.filter(F.col("studyCode").isNotNull()).select(
        "NOAAStudyId",
        "NOAASiteId",
        "siteName",
        "studyCode",
        F.lower("studyCode").alias("rwl"),
        "investigators",
        "locationName",
        F.element_at(F.split("locationName", ">"), -1).alias("country"),
        F.col("earliestYearCE").alias("first_year"),
        F.col("mostRecentYearCE").alias("last_year"),
        F.get(data, F.lit(0))["timeUnit"].alias("date_type"),
        _coordinate(0, compat).alias("latitude"),
        _coordinate(1, compat).alias("longitude"),
        F.col("geo.properties.minElevationMeters").try_cast("double").alias("elevation"),
        F.array_join(F.transform(species, lambda s: s["speciesCode"]), ", ").alias("species_code"),
        F.array_join(F.transform(species, lambda s: s["scientificName"]), ", ").alias("species_name"),
        F.array_join(F.transform("publication", lambda p: p["citation"]), "; ").alias("reference"),
        "doi",
        F.year("contributionDate").alias("contr_year"),
        F.col("onlineResourceLink").alias("url"),
    )


def analysis_metadata(metadata: DataFrame) -> DataFrame:
    """The metadata columns the analyses use, keyed by the lower-case site id."""
    return metadata.select(
        "rwl",
        "first_year",
        "last_year",
        "country",
        "latitude",
        "longitude",
        "elevation",
        "species_code",
        "species_name",
    )


def raw_files(sites: DataFrame, all_data_sets: bool = False) -> DataFrame:
    """Raw total-ring-width files of the (first) data set of every site."""
    data = F.col("paleoData")
    files = F.flatten(F.transform(data, lambda d: d["dataFile"])) if all_data_sets else F.get(data, F.lit(0))["dataFile"]
    listed = sites.select("NOAAStudyId", F.col("earliestYearCE").alias("first_year"), F.explode(files).alias("f"))
    wanted = listed.filter(
        (F.col("f.urlDescription") == RAW_DESCRIPTION) & ~F.col("f.linkText").contains(EXCLUDED_LINK)
    )
    return (
        wanted.select("NOAAStudyId", "first_year", "f.linkText", "f.fileUrl", F.explode("f.variables").alias("v"))
        .filter(F.col("v.cvWhat") == RING_WIDTH_VARIABLE)
        .select("NOAAStudyId", "first_year", "linkText", "fileUrl", "v.cvWhat", "v.cvUnit")
    )


def usable_files(files: DataFrame, status: DataFrame) -> DataFrame:
    """Files of studies without any unreadable file, with their read status.

    ``status`` is ``(NOAAStudyId, linkText, status)``.  Both sides are reduced
    to one row per file first (on the map side already), so files listed for
    several sites do not multiply; the anti join is spread by file name.
    """
    per_file = status.groupBy("NOAAStudyId", "linkText").agg(F.min("status").alias("status"))
    failed = per_file.filter(F.col("status") == "Error").select("NOAAStudyId").distinct()
    good = lookup_join(per_file, failed, "NOAAStudyId", "linkText", "left_anti")
    return files.distinct().join(good, ["NOAAStudyId", "linkText"])


def site_condition(
    species: str | None = None, country: str | None = None, min_last: int | None = None, max_last: int | None = None
) -> Column:
    """Choice of sites by species, country and range of the last year; what is not given does not matter."""
    wanted = {
        "species_code": species and (F.col("species_code") == species),
        "country": country and (F.col("country") == country),
        "first": None if min_last is None else F.col("last_year") >= min_last,
        "last": None if max_last is None else F.col("last_year") <= max_last,
    }
    chosen = F.lit(True)
    for condition in wanted.values():
        chosen = chosen if condition is None else chosen & condition
    return chosen


def site_filter(metadata: DataFrame, **wanted) -> DataFrame:
    """Site ids chosen by ``site_condition``."""
    return metadata.filter(site_condition(**wanted)).select("rwl").distinct()


def site_of_file() -> Column:
    """Site id of a listed file: its name without the suffix, as ``ring_text.site_of_path`` has it."""
    return F.lower(F.regexp_replace("linkText", r"\.[^.]*$", ""))


def long_sites(files: DataFrame, before: int = -999) -> DataFrame:
    """Sites whose files use the long text variant: those that start before -999."""
    return files.filter(F.col("first_year") < before).select(site_of_file().alias("rwl")).distinct()


def file_checks(files: DataFrame, status: DataFrame) -> DataFrame:
    """``(NOAAStudyId, linkText, status)`` of every listed file from the status by site; what was not found is an error."""
    listed = files.select("NOAAStudyId", "linkText", site_of_file().alias("rwl")).distinct()
    checked = listed.join(status.select("rwl", "status"), "rwl", "left")
    return checked.select("NOAAStudyId", "linkText", F.coalesce("status", F.lit("Error")).alias("status"))
