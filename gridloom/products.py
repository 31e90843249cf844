"""Product profiles: bands, cloud masks and radiometry as small dimension tables."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CloudMask:
    """Band of the mask file (1-based), the values that mean clear, and the mask file's name ending."""

    band_index: int
    clear_values: tuple[int, ...]
    file_suffix: str = ""


@dataclass(frozen=True)
class ProductProfile:
    product_id: str
    bands: dict[str, int]
    resolution: float | None = None
    provider: str | None = None
    description: str | None = None
    cloud_mask: CloudMask | None = None
    extra_fields: dict = field(default_factory=dict)

    @property
    def band_names(self) -> list[str]:
        return sorted(self.bands, key=self.bands.__getitem__)

    @property
    def band_count(self) -> int:
        return len(self.bands)

    def to_dict(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_dict(d: dict) -> ProductProfile:
        mask = d.get("cloud_mask")
        return ProductProfile(**{**d, "cloud_mask": CloudMask(**{**mask, "clear_values": tuple(mask["clear_values"])}) if mask else None})


# Profiles of common public products, bands in the order of their files. Band indices of masks count from 1.
_LANDSAT = {"coastal_aerosol": 0, "blue": 1, "green": 2, "red": 3, "nir": 4, "swir_1": 5, "swir_2": 6}
BUILT_IN = [
    ProductProfile("planet_sr", {"blue": 0, "green": 1, "red": 2, "nir": 3}, 3.0, "Planet", "PlanetScope Surface Reflectance (4-band)", CloudMask(6, (0,), "_udm2")),
    ProductProfile(
        "sentinel2_l2a",
        {
            "coastal_aerosol": 0, "blue": 1, "green": 2, "red": 3, "vegetation_red_edge_1": 4, "vegetation_red_edge_2": 5, "vegetation_red_edge_3": 6,
            "nir": 7, "narrow_nir": 8, "water_vapour": 9, "swir_cirrus": 10, "swir_1": 11, "swir_2": 12,
        },
        10.0, "ESA", "Sentinel-2 Level-2A Surface Reflectance", CloudMask(1, (4, 5, 6, 7, 11), "_SCL"),
    ),
    ProductProfile("landsat8_sr", _LANDSAT, 30.0, "USGS", "Landsat 8 Collection 2 Surface Reflectance", CloudMask(1, (21824,), "_QA_PIXEL")),
    ProductProfile("landsat9_sr", _LANDSAT, 30.0, "USGS", "Landsat 9 Collection 2 Surface Reflectance", CloudMask(1, (21824,), "_QA_PIXEL")),
]

SCHEMA = "product_id string, bands map<string,int>, resolution double, provider string, description string, cloud_mask struct<band_index:int,clear_values:array<int>,file_suffix:string>, extra_fields string"


class ProductRegistry:
    """Registered profiles of a session; a later registration of an id replaces the earlier one."""

    def __init__(self, profiles: list[ProductProfile] | None = None):
        self._profiles = {p.product_id: p for p in profiles or []}

    @staticmethod
    def with_built_in() -> ProductRegistry:
        return ProductRegistry(BUILT_IN)

    def register(self, profile: ProductProfile) -> None:
        self._profiles[profile.product_id] = profile

    def get(self, product_id: str) -> ProductProfile:
        if product_id not in self._profiles:
            raise KeyError(f"no product {product_id}; there are {sorted(self._profiles)}")
        return self._profiles[product_id]

    def list(self) -> list[str]:
        return sorted(self._profiles)

    def to_dict(self) -> dict[str, dict]:
        return {k: p.to_dict() for k, p in self._profiles.items()}

    def load(self, df: DataFrame) -> None:
        """Register the profiles of a products table (a dimension table of a catalogue)."""
        for r in df.collect():
            mask = r["cloud_mask"] if "cloud_mask" in df.columns and r["cloud_mask"] else None
            extra = json.loads(r["extra_fields"]) if "extra_fields" in df.columns and r["extra_fields"] else {}
            self.register(ProductProfile(r["product_id"], dict(r["bands"] or {}), r["resolution"], r["provider"], r["description"], CloudMask(mask["band_index"], tuple(mask["clear_values"]), mask["file_suffix"]) if mask else None, extra))

    def save(self, spark: SparkSession, warehouse: str) -> int:
        """Keep the profiles beside a warehouse, in place of those kept there before; the id of the snapshot."""
        return self._store(spark, warehouse).overwrite(self.to_df(spark), message="products")

    def load_from(self, spark: SparkSession, warehouse: str) -> None:
        """Register the profiles kept beside a warehouse."""
        self.load(self._store(spark, warehouse).read())

    @staticmethod
    def _store(spark: SparkSession, warehouse: str):
        from gridloom.warehouse import Warehouse

        return Warehouse(spark, f"{warehouse.rstrip('/')}/_products", spark.createDataFrame([], SCHEMA).schema, [])

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(p.product_id, p.bands, p.resolution, p.provider, p.description, (p.cloud_mask.band_index, list(p.cloud_mask.clear_values), p.cloud_mask.file_suffix) if p.cloud_mask else None, json.dumps(p.extra_fields)) for p in self._profiles.values()]
        return spark.createDataFrame(rows, SCHEMA)


def ordered_bands(bands: Column) -> Column:
    """Band names in the order of their index."""
    return F.transform(F.array_sort(F.transform(F.map_entries(bands), lambda e: F.struct(e["value"].alias("i"), e["key"].alias("b")))), lambda s: s["b"])


def bands_of_resolution(bands: DataFrame, metres: float) -> DataFrame:
    return bands.where(F.col("resolution") == metres)


def band_by_native_name(bands: DataFrame, product_id: str, native_name: str) -> str:
    row = bands_by_native_name(bands, [native_name]).where(F.col("product_id") == product_id).select("band").first()
    if row is None:
        raise KeyError(f"{product_id} has no band {native_name}")
    return row[0]


def bands_by_native_name(bands: DataFrame, names: list[str]) -> DataFrame:
    """The bands of all products that carry one of the native names."""
    return bands.where(F.col("native_name").isin(names))


def common_bands(bands: DataFrame) -> DataFrame:
    """Bands that every product has."""
    products = bands.agg(F.countDistinct("product_id").alias("_n"))  # one row
    return bands.groupBy("band").agg(F.countDistinct("product_id").alias("products")).join(F.broadcast(products), F.col("products") == F.col("_n")).select("band")


def to_reflectance(observations: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds ``reflectance``, the pixels by the product's scale and offset, NULL at nodata and for unknown products."""
    p = profiles.select(F.col("product_id").alias("_p"), "scale_factor", "value_offset", "nodata")
    joined = observations.join(p, F.col("product_id") == F.col("_p"), "left")
    value = F.transform("pixels", lambda v: F.when(~v.eqNullSafe(F.col("nodata")), v * F.col("scale_factor") + F.col("value_offset")))
    return joined.withColumn("reflectance", F.when(F.col("scale_factor").isNotNull(), value)).drop("_p", "scale_factor", "value_offset", "nodata")


def as_json(profiles: DataFrame) -> DataFrame:
    """product_id and the profile as a JSON object; ``from_json`` with the same fields gives it back."""
    return profiles.select("product_id", F.to_json(F.struct(*sorted(profiles.columns))).alias("profile"))
