"""Query registry: one Spark function and, where SQL can say it, one check query."""

from __future__ import annotations

import importlib
import pkgutil
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amberline.session import materialise
from amberline.sources import star_panel


@dataclass(frozen=True)
class Tables:
    """The given tables, and the views derived from them."""

    spark: SparkSession
    sf_dir: str

    def read(self, name: str) -> DataFrame:
        return star_panel.read_table(self.spark, self.sf_dir, name)

    def panel(self) -> DataFrame:
        return star_panel.scored_panel(self.spark, self.sf_dir)

    def with_stored_panel(self) -> Tables:
        """The same tables with the derived panel written once, for queries that read it many times."""
        return _StoredTables(self.spark, self.sf_dir, materialise(star_panel.scored_panel(self.spark, self.sf_dir), "panel"))

    def quarters(self) -> star_panel.Calendar:
        return star_panel.calendar(self.spark, self.sf_dir)

    def accounts(self) -> DataFrame:
        return star_panel.accounts(self.spark, self.sf_dir)

    def eligible(self) -> DataFrame:
        return self.panel().where(F.col("labelable") == 1)

    def stored(self, df: DataFrame, *columns: str) -> DataFrame:
        """The named columns of a derived table, written once for operators that read it several times."""
        return materialise(df.select(*columns), "panel")

    def book(self) -> DataFrame:
        """The frozen book: one row per account at the reference period, banded."""
        return self.panel().where(F.col("period") == star_panel.REFERENCE_PERIOD).withColumn(
            "band", F.when(F.col("decision_score") >= star_panel.RED, "red")
            .when(F.col("decision_score") >= star_panel.AMBER, "amber").otherwise("green"))


@dataclass(frozen=True)
class _StoredTables(Tables):
    stored_panel: DataFrame

    def panel(self) -> DataFrame:
        return self.stored_panel


# Views a check query may name; each is added only when it is mentioned.
VIEWS_SQL = {
    "book": """book AS (SELECT *, CASE WHEN decision_score >= 0.40 THEN 'red'
 WHEN decision_score >= 0.28 THEN 'amber' ELSE 'green' END AS band FROM panel WHERE period = 16)""",
    "eligible": "eligible AS (SELECT * FROM panel WHERE labelable = 1)",
}

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` under ``name`` with its SQL check."""

    def register(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _CHECKS[name] = _with_views(sql)
        return fn

    return register


def check_sql(name: str) -> str:
    """The SQL check of a registered query, for a check that is made of others."""
    return _CHECKS[name]


def _mentions(sql: str, word: str) -> bool:
    return re.search(rf"\b{word}\b", sql) is not None


def _with_views(sql: str) -> str:
    body = sql.strip()
    views = [text for view, text in VIEWS_SQL.items() if _mentions(body, view)]
    names = ("panel", "book", "eligible", "acc", "grid", "run", "npa", "std", "bounds")
    if not any(_mentions(body, n) for n in names):
        return body
    ctes = [star_panel.PANEL_SQL, *views]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _load() -> None:
    package = importlib.import_module("amberline.plans")
    for module in pkgutil.iter_modules(package.__path__):
        importlib.import_module(f"amberline.plans.{module.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn):
        return lambda spark, sf_dir: fn(Tables(spark, sf_dir))

    return {name: bind(fn) for name, fn in sorted(_QUERIES.items())}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(sorted(_CHECKS.items()))
