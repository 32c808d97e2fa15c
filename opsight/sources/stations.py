"""The station reference table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opsight.schemas import STATIONS, STATIONS_SCHEMA

# --- fixed values: station_id, display_name, specialization, max_capacity, avg_prep_minutes, is_active ---------------
STATION_ROWS = [
    ("grill", "Plancha / Parrilla", "Carnes, hamburguesas, filetes", 4, 8.0, True),
    ("fryer", "Freidora", "Patatas fritas, croquetas, alitas", 4, 6.0, True),
    ("sauces", "Salsas y Aderezos", "Salsas, ensaladas, preparaciones", 3, 3.0, True),
    ("assembly", "Montaje Final", "Ensamblaje del plato y empaquetado", 5, 2.0, True),
]
# --------------------------------------------------------------------------------------------------------------------


def stations(spark: SparkSession) -> DataFrame:
    """The seed rows as an inline table: the optimizer knows its size, so joins with it broadcast on their own."""
    rows = ", ".join(
        f"('{sid}', '{name}', '{kind}', {cap}L, {prep}D, {str(active).lower()})"
        for sid, name, kind, cap, prep, active in STATION_ROWS
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({', '.join(STATIONS_SCHEMA.fieldNames())})")


def write_stations(spark: SparkSession, root: str) -> None:
    """Set the stored reference table to the seed rows; running it again changes nothing."""
    stations(spark).coalesce(1).write.mode("overwrite").parquet(f"{root}/{STATIONS}")


def read_stations(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(STATIONS_SCHEMA).parquet(f"{root}/{STATIONS}")
