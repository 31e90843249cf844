"""One unit for quantities that come in several.

Method: one multi-pattern automaton (Aho-Corasick) holds all unit aliases and all
field words. It runs once over every scene's header text; of overlapping hits the
longest stays, and a field word beside a number and unit decides what the number
measures, so that an antenna in feet or an orbit in kilometres is no pixel size.
The hits give votes, the votes a verdict per file (pixel size) and per tile and
satellite (pixel encoding); conversion factors are a small fixed table that is
broadcast. Where no text speaks, the numbers do: the pixel size against the
nominal sizes of its product's bands, the pixels against the levels that each
encoding can have.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.tiles import ID_INSIDE, canonical_or_self, tile_text, tile_x, tile_y

# Metres in one unit of length; degrees as on the equator of the grid's sphere.
METRES = {
    "m": 1.0,
    "mm": 0.001,
    "cm": 0.01,
    "km": 1000.0,
    "ft": 0.3048,
    "deg": 111319.49079327358,
    "arcsec": 111319.49079327358 / 3600,
}
# Spellings of the units of length.
LENGTH_ALIASES = {
    "m": "m", "mtr": "m", "meter": "m", "meters": "m", "metre": "m", "metres": "m",
    "mm": "mm", "millimetre": "mm", "millimetres": "mm", "millimeter": "mm", "millimeters": "mm",
    "cm": "cm", "centimetre": "cm", "centimetres": "cm", "centimeter": "cm", "centimeters": "cm",
    "km": "km", "kilometre": "km", "kilometres": "km", "kilometer": "km", "kilometers": "km",
    "ft": "ft", "foot": "ft", "feet": "ft",
    "deg": "deg", "degree": "deg", "degrees": "deg", "°": "deg",
    "arcsec": "arcsec", "arcseconds": "arcsec", "sec of arc": "arcsec", '"': "arcsec",
}
# Words that say that the number beside them is the pixel size, or that it is something else.
SIZE_WORDS = ("resolution", "pixel size", "ground sampling distance", "gsd", "cell", "res:", "/px", "per pixel")
OTHER_WORDS = ("antenna", "orbit", "swath", "terrain model", "look angle", "band width", "cloud", "qa", "chain", "focal")
# reflectance = pixel * scale + offset. "profile" stands for the product's own scale and offset.
ENCODINGS = {
    "percent": (0.01, 0.0),
    "permille": (0.001, 0.0),
    "ppm": (1e-6, 0.0),
    "byte": (1 / 255, 0.0),
    "e4": (1e-4, 0.0),
    "e4_plus_1000": (1e-4, -0.1),
}
# Spellings of the scale of a quantity without dimension. Words speak for themselves; numbers only beside a
# word for the quantity.
SCALE_WORDS = {
    "percent": "percent", "per cent": "percent", "pct": "percent", "%": "percent",
    "per mille": "permille", "permille": "permille", "per mil": "permille", "milli": "permille", "‰": "permille",
    "ppm": "ppm", "parts per million": "ppm", "micro": "ppm",
    "8-bit": "byte", "8 bit": "byte", "u8": "byte", "uint8": "byte", "byte": "byte",
}
SCALE_NUMBERS = {
    "1/100": "percent", "0.01": "percent", "1e-2": "percent", "1/1000": "permille", "0.001": "permille", "1e-3": "permille",
    "0.000001": "ppm", "1e-6": "ppm", "1000000": "ppm", "1e6": "ppm", "1/255": "byte", "255": "byte",
    "1/10000": "e4", "0.0001": "e4", "1e-4": "e4", "10000": "e4", "1e4": "e4",
}
# What is added to every number of the scale above.
OFFSET_NUMBERS = ("+1000", "+ 1000", "-1000", "- 1000", "1000 added")
# Words for the quantity, and words for a product in its own encoding.
QUANTITY_WORDS = ("reflectance", "refl", "unit", "units", "scale", "scaled", "offset", "factor")
OWN_WORDS = ("native", "profile", "standard", "integer", "surface reflectance")
#: Mean reflectance that a scene over land or water can have.
POSSIBLE = (0.004, 1.3)
#: Mean reflectance that most rows stay below.
TYPICAL = 0.6
#: A size in the text is the row's own if it differs by less than this share.
SAME = 0.002
#: A size is a nominal one if it differs by less than this share.
NOMINAL = 0.02
_NUMBER = re.compile(r"\d+(?:[.,]\d+)?(?:e[+-]?\d+)?")


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    words: dict[str, tuple] = {}
    for alias, unit in LENGTH_ALIASES.items():
        words[alias] = ("unit", unit)
    for word in SIZE_WORDS:
        words[word] = ("size", word)
    for word in OTHER_WORDS:
        words[word] = ("other", word)
    for kind, aliases in (("scale", SCALE_WORDS), ("number", SCALE_NUMBERS)):
        for alias, encoding in aliases.items():
            words[alias] = (kind, encoding)
    for kind, listed in (("offset", OFFSET_NUMBERS), ("quantity", QUANTITY_WORDS), ("own", OWN_WORDS)):
        for word in listed:
            words[word] = (kind, word)
    for word, meaning in words.items():
        a.add_word(word, (len(word), *meaning))
    a.make_automaton()
    return a


def _hits(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value): the longest hits, none inside another; words must stand alone."""
    found = []
    for end, (n, kind, value) in _automaton().iter(text):
        start, stop = end - n + 1, end + 1
        for inner, outer in ((text[start], text[start - 1 : start]), (text[stop - 1], text[stop : stop + 1])):
            if inner.isalpha() and outer.isalpha() or inner.isdigit() and (outer.isdigit() or kind in ("number", "offset") and outer in (".", "/") and outer):
                break
        else:
            found.append((start, stop, kind, value))
    found.sort(key=lambda h: (h[0] - h[1], h[0]))
    kept: list[tuple[int, int, str, str]] = []
    for h in found:
        if all(h[1] <= k[0] or h[0] >= k[1] for k in kept):
            kept.append(h)
    return sorted(kept)


def read_header(text: str | None) -> tuple[float | None, str | None, str | None]:
    """(number, unit, encoding) of a header text: the pixel size it states and the pixel encoding it names.

    The text falls into clauses at line ends, semicolons, bars and commas that are followed by a blank. A unit counts
    if it follows a number directly; its clause must hold a word for the pixel size and none for another quantity. A
    clause without either names an encoding by a scale word, or by a scale's number or an offset beside a word for the
    quantity; an offset goes with the scale of ten thousand. The product's own encoding counts only if no other is named."""
    if not text:
        return None, None, None
    number = unit = encoding = None
    for clause in re.split(r"[\n\r;|]|,\s", text.lower()):
        hits = _hits(clause)
        kinds = {h[2] for h in hits}
        if "other" in kinds:
            continue
        if "size" in kinds:
            for m in _NUMBER.finditer(clause) if unit is None else ():
                near = next((h for h in hits if h[2] == "unit" and h[0] >= m.end() and not clause[m.end() : h[0]].strip()), None)
                if near:
                    number, unit = float(m.group().replace(",", ".")), near[3]
                    break
        elif encoding in (None, "profile"):
            scales = [h[3] for h in hits if h[2] == "scale" or (h[2] == "number" and "quantity" in kinds)]
            if "offset" in kinds and "quantity" in kinds and (not scales or scales[0] == "e4"):
                encoding = "e4_plus_1000"
            elif scales:
                encoding = scales[0]
            elif "own" in kinds:
                encoding = "profile"
    return number, unit, encoding


def file_key(path: Column) -> Column:
    """Spelling-free name of a source file: no scheme, host or drive, one kind of separator, no extension. Plain paths
    are spared the patterns that they cannot match."""
    p = F.lower(F.trim(path))
    clean = F.regexp_replace(F.regexp_replace(p, r"[/\\]+", "/"), r"^(?:[a-z0-9+]+:/[^/]+(?=/)|[a-z]:)", "")
    odd = p.contains("//") | p.contains("\\") | p.contains(":")
    return F.regexp_replace(F.when(odd, clean).otherwise(p), r"\.[a-z0-9]{1,5}$", "")


def header_facts(scenes_index: DataFrame) -> DataFrame:
    """(file_key, tile_id, satellite_id, size_number, size_unit, encoding) per scene row, by the automaton."""
    inside = ID_INSIDE
    p = F.col("source_file")
    thin = scenes_index.select(
        file_key(p).alias("file_key"), tile_text(tile_x(p, inside), tile_y(p, inside)).alias("tile_id"), "satellite_id", F.col("image_description").alias("header")
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, tuple] = {}
        for batch in batches:
            facts = []
            for text in batch.column("header").to_pylist():
                if text not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[text] = read_header(text)
                facts.append(known[text])
            out = [*batch.columns[:3], pa.array([f[0] for f in facts], pa.float64()), pa.array([f[1] for f in facts], pa.string()), pa.array([f[2] for f in facts], pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=["file_key", "tile_id", "satellite_id", "size_number", "size_unit", "encoding"])

    return thin.mapInArrow(scan, "file_key string, tile_id string, satellite_id string, size_number double, size_unit string, encoding string")


def size_texts(facts: DataFrame) -> DataFrame:
    """One row per file: the pixel size its header states. Of repeated index rows the largest (number, unit) stays."""
    return (
        facts.where(F.col("file_key").isNotNull() & F.col("size_unit").isNotNull())
        .groupBy("file_key")
        .agg(F.max(F.struct("size_number", "size_unit")).alias("t"))
        .select("file_key", "t.size_number", "t.size_unit")
    )


def encoding_votes(facts: DataFrame) -> DataFrame:
    """(tile_id, satellite_id, encoding, n): how many headers of the group name each encoding."""
    return facts.where(F.col("encoding").isNotNull()).groupBy("tile_id", "satellite_id", "encoding").agg(F.count(F.lit(1)).alias("n"))


def voted_encoding(levels: DataFrame, votes: DataFrame) -> DataFrame:
    """Adds text_encoding to groups (tile_id, satellite_id, level, own_scale, own_offset): what most headers say. A vote
    counts only if the group's level then is a possible reflectance, so a stray phrase decides nothing. The product's own
    encoding is also the phrase of headers that say nothing particular: it wins only where nothing else has a fifth of
    its votes."""
    table = F.broadcast(factors(levels.sparkSession))  # six fixed rows
    named = votes.join(table, "encoding", "left").withColumnsRenamed({"tile_id": "v_tile", "satellite_id": "v_sat"})
    both = levels.join(named, levels["tile_id"].eqNullSafe(F.col("v_tile")) & levels["satellite_id"].eqNullSafe(F.col("v_sat")), "left")
    value = F.col("level") * F.coalesce("f_scale", "own_scale") + F.coalesce("f_offset", "own_offset")
    counts = F.col("encoding").isNotNull() & value.between(*POSSIBLE)
    weight = F.when(F.col("encoding") == "profile", F.col("n")).otherwise(F.col("n") * 5)
    best = F.max_by(F.when(counts, F.col("encoding")), F.when(counts, F.struct(weight, F.col("encoding"))))
    return both.groupBy("tile_id", "satellite_id", "level_encoding").agg(best.alias("text_encoding"))


def level_encoding(level: Column, scale: Column, offset: Column) -> Column:
    """What the mean pixel of a row can be encoded as, from its size alone: the product's own encoding wherever it gives
    4.5 to 120 % reflectance; else the coarsest of the usual ones under which the mean is typical, at most ``TYPICAL``;
    else millionths if they give a possible land surface; else ten thousandths where the product has an offset of its own."""
    own = level * scale + offset
    coarse = F.coalesce(*[F.when(level * ENCODINGS[e][0] <= TYPICAL, F.lit(e)) for e in ("percent", "byte", "permille")])
    return (
        F.when((own >= 0.045) & (own <= 1.2), "profile")
        .when(coarse.isNotNull(), coarse)
        .when((level * ENCODINGS["ppm"][0] >= 0.06) | (own > 1.2), "ppm")
        .otherwise(F.when((level * ENCODINGS["e4"][0] <= 1.0) & (offset != 0), "e4").otherwise("profile"))
    )


def factors(spark: SparkSession) -> DataFrame:
    """Conversion factors of the pixel encodings, a fixed table."""
    return spark.createDataFrame([(k, *v) for k, v in ENCODINGS.items()], "encoding string, f_scale double, f_offset double")


def length_factors(spark: SparkSession) -> DataFrame:
    """Metres in each unit of length, a fixed table."""
    return spark.createDataFrame(list(METRES.items()), "l_unit string, metres double")


def unit_of_size(resolution: Column, nominals: Column, number: Column, unit: Column) -> Column:
    """Unit of a pixel size. The header's unit, if the header states this very number; else the unit in which the size
    is a nominal one of the product, metres first; else metres if that is a possible pixel size, or the unit that
    brings it closest to a nominal size."""
    r = resolution.cast("double")
    close = lambda a, b, share: F.abs(a - b) <= share * b
    fits = lambda u: F.exists(nominals, lambda n: close(r * METRES[u], n, NOMINAL))
    found = F.when(unit.isNotNull() & close(r, number, SAME), unit)
    for u in METRES:
        found = found.when(fits(u), F.lit(u))
    off = lambda u: F.array_min(F.transform(nominals, lambda n: F.abs(F.ln(r * METRES[u] / n))))
    nearest = F.array_min(F.array(*[F.struct(off(u).alias("d"), F.lit(u).alias("u")) for u in METRES]))["u"]
    return found.when((r >= 0.25) & (r <= 250), F.lit("m")).when(r > 0, nearest).otherwise(F.lit("m"))


def measured_units(observations: DataFrame, scenes_index: DataFrame, profiles: DataFrame, bands: DataFrame) -> DataFrame:
    """Per observation row: encoding and factors of its pixels, unit of its resolution, and both converted.

    Columns: obs_id, tile_id, satellite_id, product_id, band, pixels, resolution, encoding, encoding_by (text, level), size_by
    (text, nominal, range), scale, offset, own_scale, own_offset, size_unit, resolution_m, converted (pixels are in another
    unit than the profile's). Rows of a product
    without a profile keep NULL factors; NULL pixels or resolution give NULL. Every row comes out once. Profiles and
    bands are dimension tables of a product catalogue; they are broadcast by Spark itself if small."""
    facts = header_facts(scenes_index)
    nominal = bands.where(F.col("resolution") > 0).groupBy("product_id").agg(F.collect_set(F.col("resolution").cast("double")).alias("nominals"))
    products = profiles.dropDuplicates(["product_id"]).select(
        F.col("product_id").alias("p_id"), F.col("scale_factor").alias("own_scale"), F.col("value_offset").alias("own_offset"), F.col("resolution").alias("p_resolution")
    )
    products = products.join(nominal, F.col("p_id") == nominal["product_id"], "left").select(
        "p_id", "own_scale", "own_offset", F.coalesce("nominals", F.array(F.col("p_resolution").cast("double"))).alias("nominals")
    )
    rows = observations.select(
        "obs_id",
        canonical_or_self("tile_id").alias("tile_id"),
        "satellite_id",
        "product_id",
        "band",
        "pixels",
        F.col("pixels").isNotNull().alias("has_pixels"),  # known without carrying the pixels
        "resolution",
        # rows without a file must not meet in one task
        F.coalesce(file_key(F.col("source_file")), F.concat(F.lit("?"), F.col("obs_id").cast("string"))).alias("file_key"),
    ).join(products, F.col("product_id") == F.col("p_id"), "left")
    px = F.filter(F.coalesce("pixels", F.array().cast("array<int>")), lambda p: p.isNotNull())
    level = F.try_divide(F.aggregate(px, F.lit(0).cast("long"), lambda a, p: a + p).cast("double"), F.size(px).cast("double"))
    classed = (
        rows.where(F.col("own_scale").isNotNull())
        .select("tile_id", "satellite_id", level.alias("l"), "own_scale", "own_offset")  # a step of its own: the level is used often
        .where(F.col("l").isNotNull())
        .withColumn("e", level_encoding(F.col("l"), F.col("own_scale"), F.col("own_offset")))
        .groupBy("tile_id", "satellite_id", "e")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.ln(F.greatest("l", F.lit(1.0)))).alias("s"), F.min("own_scale").alias("own_scale"), F.min("own_offset").alias("own_offset"))
    )
    levels = classed.groupBy("tile_id", "satellite_id").agg(
        F.max_by("e", F.struct("n", "e")).alias("level_encoding"), F.exp(F.sum("s") / F.sum("n")).alias("level"), F.min("own_scale").alias("own_scale"), F.min("own_offset").alias("own_offset")
    )
    voted = voted_encoding(levels, encoding_votes(facts))
    verdicts = voted.select(F.col("tile_id").alias("v_tile"), F.col("satellite_id").alias("v_sat"), F.coalesce("text_encoding", "level_encoding").alias("encoding"), F.when(F.col("text_encoding").isNotNull(), "text").otherwise("level").alias("encoding_by"))
    texts = size_texts(facts).withColumnRenamed("file_key", "t_key")
    sized = rows.join(texts, F.col("file_key") == F.col("t_key"), "left")
    full = sized.join(verdicts, F.col("tile_id").eqNullSafe(F.col("v_tile")) & F.col("satellite_id").eqNullSafe(F.col("v_sat")), "left")
    table = F.broadcast(factors(observations.sparkSession))  # six fixed rows
    full = full.join(table.withColumnRenamed("encoding", "f_encoding"), F.col("encoding") == F.col("f_encoding"), "left")
    scale, offset = F.coalesce("f_scale", "own_scale"), F.coalesce("f_offset", "own_offset")
    unit = F.when(F.col("resolution").isNotNull(), unit_of_size(F.col("resolution"), F.coalesce("nominals", F.array().cast("array<double>")), F.col("size_number"), F.col("size_unit")))
    stated = F.col("size_unit").isNotNull() & (F.abs(F.col("resolution").cast("double") - F.col("size_number")) <= SAME * F.col("size_number"))
    nominal_metres = F.exists(F.coalesce("nominals", F.array().cast("array<double>")), lambda n: F.abs(F.col("resolution").cast("double") * F.col("metres") - n) <= NOMINAL * n)
    size_by = F.when(F.col("resolution").isNull(), F.lit(None)).when(stated, "text").when(nominal_metres, "nominal").otherwise("range")
    lengths = F.broadcast(length_factors(observations.sparkSession))  # seven fixed rows
    other = ((F.abs(scale - F.col("own_scale")) > 1e-12) | (F.abs(offset - F.col("own_offset")) > 1e-12)) & F.col("has_pixels")
    return full.withColumn("unit", unit).join(lengths, F.col("unit") == F.col("l_unit"), "left").select(
        "obs_id",
        "tile_id",
        "satellite_id",
        "product_id",
        "band",
        "pixels",
        "resolution",
        F.coalesce("encoding", F.lit("profile")).alias("encoding"),
        "encoding_by",
        size_by.alias("size_by"),
        scale.alias("scale"),
        offset.alias("offset"),
        "own_scale",
        "own_offset",
        F.col("unit").alias("size_unit"),
        (F.col("resolution").cast("double") * F.col("metres")).alias("resolution_m"),
        F.coalesce(other, F.lit(False)).alias("converted"),
    )


def evidence(units: DataFrame) -> DataFrame:
    """(encoding_by, size_by, rows): by what the units of how many rows were told."""
    return units.groupBy("encoding_by", "size_by").agg(F.count(F.lit(1)).alias("rows"))


def in_common_units(units: DataFrame) -> DataFrame:
    """obs_id, reflectance (a fraction per pixel), resolution_m."""
    return units.select("obs_id", F.transform("pixels", lambda p: p * F.col("scale") + F.col("offset")).alias("reflectance"), "resolution_m")


def other_units(units: DataFrame) -> DataFrame:
    """(obs_id, field): values that were in another unit than the common one."""
    field = F.array_compact(F.array(F.when(F.col("converted"), F.lit("pixels")), F.when(F.col("size_unit") != "m", F.lit("resolution"))))
    return units.select("obs_id", F.explode(field).alias("field"))
