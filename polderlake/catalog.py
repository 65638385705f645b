"""Dataset contracts: what a dataset is called, its grain, columns and measures."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql.types import StructType


@dataclass(frozen=True)
class DatasetSpec:
    """Contract of one dataset.

    ``schema`` types the source columns, ``columns`` maps source names to
    business names, ``grain`` and ``measures`` are business names.
    """

    source: str
    name: str
    silver_table: str
    schema: StructType
    grain: tuple[str, ...] = ()
    columns: Mapping[str, str] = field(default_factory=dict)
    measures: tuple[str, ...] = ()
    table_id: str | None = None
    endpoints: tuple[str, ...] = ()
    dimensions: tuple[str, ...] = ()

    def source_name(self, business_name: str) -> str:
        for raw, business in self.columns.items():
            if business == business_name:
                return raw
        return business_name

    @property
    def source_grain(self) -> tuple[str, ...]:
        return tuple(self.source_name(c) for c in self.grain)

    @property
    def silver_schema(self) -> StructType:
        """Source columns followed by the lineage columns."""
        return StructType(list(self.schema.fields) + list(LINEAGE_FIELDS))


def schema_of(**types: str) -> StructType:
    """A schema from names and type names (``long``, ``integer``, ...), without a session."""
    schema = StructType()
    for name, kind in types.items():
        schema = schema.add(name, kind)
    return schema


LINEAGE_FIELDS = schema_of(ingestion_timestamp="timestamp", source="string",
                           dataset_name="string", ingestion_date="string").fields


def load_catalog(specs: Iterable[DatasetSpec]) -> dict[tuple[str, str], DatasetSpec]:
    """Index specs by (source, name); a repeated or inconsistent entry is an error."""
    catalog: dict[tuple[str, str], DatasetSpec] = {}
    tables: set[str] = set()
    for spec in specs:
        key = (spec.source, spec.name)
        if key in catalog:
            raise ValueError(f"dataset declared twice: {spec.source}.{spec.name}")
        if spec.silver_table in tables:
            raise ValueError(f"silver table declared twice: {spec.silver_table}")
        unknown = [raw for raw in spec.columns if raw not in spec.schema.fieldNames()]
        if unknown:
            raise ValueError(f"{spec.name}: renamed columns missing from the schema: {unknown}")
        business = set(spec.columns.values()) | set(spec.schema.fieldNames())
        missing = [c for c in (*spec.grain, *spec.measures) if c not in business]
        if missing:
            raise ValueError(f"{spec.name}: grain or measure not among the columns: {missing}")
        if len(set(spec.columns.values())) != len(spec.columns):
            raise ValueError(f"{spec.name}: two columns share one business name")
        catalog[key] = spec
        tables.add(spec.silver_table)
    return catalog


# Identifiers, column names and layouts of the published sources.
_STATISTICS_ENDPOINTS = ("TableInfos", "DataProperties", "TypedDataSet")

STATISTICS = (
    DatasetSpec(
        source="cbs",
        name="neighbourhood_key_figures",
        table_id="84583NED",
        silver_table="silver_cbs_neighbourhood_key_figures",
        schema=schema_of(
            RegioS="string", RegioNaam="string", SoortRegio_2="string",
            Perioden="string", Inwoners_5="long", AantalHuishoudens_10="long",
            GemiddeldInkomenPerInwoner_25="decimal(18,2)"),
        columns={
            "RegioS": "region_code",
            "RegioNaam": "region_name",
            "SoortRegio_2": "region_type",
            "Perioden": "period_code",
            "Inwoners_5": "population",
            "AantalHuishoudens_10": "households",
            "GemiddeldInkomenPerInwoner_25": "avg_income_per_resident_eur",
        },
        grain=("region_code", "period_code"),
        measures=("population", "households", "avg_income_per_resident_eur"),
        endpoints=_STATISTICS_ENDPOINTS,
        dimensions=("Regions", "Perioden", "CategoryTables"),
    ),
    DatasetSpec(
        source="cbs",
        name="average_woz_value",
        table_id="83765NED",
        silver_table="silver_cbs_average_woz_value",
        schema=schema_of(
            RegioS="string", RegioNaam="string", Perioden="string",
            GemiddeldeWOZWaarde_1="decimal(18,2)"),
        columns={
            "RegioS": "region_code",
            "RegioNaam": "region_name",
            "Perioden": "period_code",
            "GemiddeldeWOZWaarde_1": "avg_woz_value_eur",
        },
        grain=("region_code", "period_code"),
        measures=("avg_woz_value_eur",),
        endpoints=_STATISTICS_ENDPOINTS,
        dimensions=("Regions", "Perioden"),
    ),
    DatasetSpec(
        source="cbs",
        name="housing_stock",
        table_id="82900NED",
        silver_table="silver_cbs_housing_stock",
        schema=schema_of(
            RegioS="string", RegioNaam="string", Perioden="string",
            TypeWoning_3="string", AantalWoningen_1="long"),
        columns={
            "RegioS": "region_code",
            "RegioNaam": "region_name",
            "Perioden": "period_code",
            "TypeWoning_3": "dwelling_type",
            "AantalWoningen_1": "number_of_dwellings",
        },
        grain=("region_code", "period_code", "dwelling_type"),
        measures=("number_of_dwellings",),
        endpoints=_STATISTICS_ENDPOINTS,
        dimensions=("Regions", "Perioden", "CategoryTables"),
    ),
    DatasetSpec(
        source="cbs",
        name="household_income",
        table_id="86161NED",
        silver_table="silver_cbs_household_income",
        schema=schema_of(
            RegioS="string", RegioNaam="string", Perioden="string",
            GemiddeldInkomenHuishouden_6="decimal(18,2)",
            MediaanInkomenHuishouden_7="decimal(18,2)"),
        columns={
            "RegioS": "region_code",
            "RegioNaam": "region_name",
            "Perioden": "period_code",
            "GemiddeldInkomenHuishouden_6": "avg_household_income_eur",
            "MediaanInkomenHuishouden_7": "median_household_income_eur",
        },
        grain=("region_code", "period_code"),
        measures=("avg_household_income_eur", "median_household_income_eur"),
        endpoints=_STATISTICS_ENDPOINTS,
        dimensions=("Regions", "Perioden"),
    ),
)

# Names of the feeds. Their columns are the feed's own, so the schema is open.
FEEDS = (
    DatasetSpec(source="pdok", name="addresses", silver_table="silver_pdok_addresses",
                schema=StructType()),
    DatasetSpec(source="knmi", name="weather_stations",
                silver_table="silver_knmi_weather_stations", schema=StructType()),
    DatasetSpec(source="ndw", name="traffic_flow", silver_table="silver_ndw_traffic_flow",
                schema=StructType()),
)

# Names of the feeds that land as GeoJSON, commented CSV and XML.
LANDED_FEEDS = (
    DatasetSpec(source="pdok", name="bag_pand", silver_table="silver_pdok_bag_pand",
                schema=StructType()),
    DatasetSpec(source="pdok", name="bag_verblijfsobject",
                silver_table="silver_pdok_bag_verblijfsobject", schema=StructType()),
    DatasetSpec(source="knmi", name="daily_weather_all_stations",
                silver_table="silver_knmi_daily_weather_all_stations", schema=StructType()),
    DatasetSpec(source="ndw", name="current_traffic_sample",
                silver_table="silver_ndw_current_traffic_sample", schema=StructType()),
)

# Days back for the weather feed's relative window.
WEATHER_START_DAYS_AGO = 7
WEATHER_END_DAYS_AGO = 1

# File extension by declared payload format, and the fallback.
EXTENSIONS = {"json": "json", "xml": "xml"}
DEFAULT_EXTENSION = "csv"

# Fixed value: rows per page part when none is given.
PAGE_SIZE = 10_000


def bronze_path(root: str, spec: DatasetSpec) -> str:
    """Root of one dataset's landed files; partitions are ``ingestion_date=YYYY-MM-DD``."""
    return f"{root}/{spec.source}/{spec.source}_bronze/{spec.name}"


def silver_path(root: str, spec: DatasetSpec) -> str:
    return f"{root}/{spec.source}/{spec.silver_table}"


def current_path(root: str, spec: DatasetSpec, as_of: str) -> str:
    """Latest row per grain after the load of ``as_of``, kept beside the silver table."""
    return f"{silver_path(root, spec)}_current/as_of={as_of}"


def gold_path(root: str, group: str, table: str) -> str:
    return f"{root}/{group}/{table}"
