"""A small set of sample rasters, the same on every call."""

from __future__ import annotations

import os
import tempfile

import numpy as np

from gridloom.sources import tiff

# Fixed values of the sample: three dates, four bands, 64 x 64 pixels of 10 m in UTM zone 52N, seed 42.
DATES = ("2024-01-15", "2024-02-15", "2024-03-15")
BANDS = ("blue", "green", "red", "nir")
SIZE, METRES, EPSG, SEED, CORNER = 64, 10.0, 32652, 42, (320_000.0, 4_160_000.0)


def create_sample_data(folder: str) -> list[str]:
    """Write the rasters as deflate-compressed tiles; returns their paths in order of time."""
    os.makedirs(folder, exist_ok=True)
    rng = np.random.default_rng(SEED)
    x0, y0 = CORNER
    bounds = (x0, y0, x0 + SIZE * METRES, y0 + SIZE * METRES)
    out = []
    for k, day in enumerate(DATES):
        level = np.array([600, 900, 800, 2500 + 500 * k])[:, None, None]
        a = np.clip(level + rng.normal(0, 60, (len(BANDS), SIZE, SIZE)), 1, 10_000).astype(np.uint16)
        path = os.path.join(folder, f"sample_{day.replace('-', '')}.tif")
        with open(path, "wb") as f:
            f.write(tiff.write(a, bounds, EPSG, nodata=0, names=list(BANDS), compression=tiff.DEFLATE, tile=32))
        out.append(path)
    return out


def sample_data_path() -> str:
    """Folder of the sample, made on first use."""
    folder = os.path.join(tempfile.gettempdir(), "gridloom-sample")
    if not all(os.path.exists(os.path.join(folder, f"sample_{d.replace('-', '')}.tif")) for d in DATES):
        create_sample_data(folder)
    return folder
