"""The registered queries of the library, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrystat.plans import basic
from quarrystat.plans import designs as _designs
from quarrystat.plans import dynamics as _dynamics
from quarrystat.plans import effects as _effects
from quarrystat.plans import learned as _learned
from quarrystat.plans import models as _models  # these register their queries in basic
from quarrystat.plans import more as _more
from quarrystat.plans import panels as _panels


MODULES = (basic, _models, _more, _dynamics, _panels, _effects, _learned, _designs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(basic.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(basic.SQL)
