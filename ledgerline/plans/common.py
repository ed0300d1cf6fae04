"""Shared pieces for the registered queries."""

from __future__ import annotations

from typing import Iterable, Optional

from pyspark.sql import DataFrame, SparkSession

from ..functions.roles import Roles
from ..sources import star
from ..sources.tables import SALES_COLUMNS, sales, sales_oracle_cte


def sales_roles() -> Roles:
    """Roles of the sales view, resolved by the keyword rules on its column order."""
    from pyspark.sql.types import (
        DateType, DecimalType, DoubleType, LongType, StringType, StructField, StructType,
    )

    types = {
        "date": DateType(), "product_id": LongType(), "product_name": StringType(),
        "category": StringType(), "region": StringType(), "store_id": LongType(),
        "customer_id": LongType(), "quantity": DoubleType(), "unit_price": DoubleType(),
        "revenue": DecimalType(18, 2), "cost": DecimalType(18, 2), "profit": DecimalType(19, 2),
    }
    return Roles.resolve(StructType([StructField(c, types[c]) for c in SALES_COLUMNS]))


ROLES = sales_roles()


def S(spark: SparkSession, sf_dir: str, cols: Optional[Iterable[str]] = None) -> DataFrame:
    """The sales view, without the joins that verified keys make needless (query ``star_keys`` verifies them)."""
    return sales(spark, sf_dir, cols, verified=star.verified(spark, sf_dir))


def R(expr: str, digits: int = 2) -> str:
    """Oracle twin of ``functions.numeric.round_to``."""
    return f"CAST(ROUND(TRY_CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def with_sales(body: str, extra_ctes: str = "") -> str:
    ctes = sales_oracle_cte() + (",\n" + extra_ctes if extra_ctes else "")
    return f"WITH {ctes}\n{body}"
