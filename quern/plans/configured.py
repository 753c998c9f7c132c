"""The cleaners with the tables of the settings, for callers who have a raw table and no settings at hand."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from quern.operators import cleaning
from quern.sources.settings import get_settings, normalization


def clean_customers(raw: DataFrame, settings: Mapping | None = None) -> DataFrame:
    """Silver customers, with the city spellings of `settings` (of the configuration, if None)."""
    cities, _, _ = normalization(settings or get_settings())
    return cleaning.clean_customers(raw, cities)


def clean_products(raw: DataFrame, settings: Mapping | None = None) -> DataFrame:
    """Silver products, with the categories and look-alike letters of `settings`."""
    _, categories, leet = normalization(settings or get_settings())
    return cleaning.clean_products(raw, categories, leet)


def clean_sales(raw: DataFrame, customers: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Silver sales and rejected ones, over clean customers and products."""
    judged = cleaning.judge_sales(raw, customers, products)
    return cleaning.accepted_sales(judged), cleaning.rejected_sales(judged)


def clean_weather(raw: DataFrame) -> DataFrame:
    """Silver weather, which no setting changes."""
    return cleaning.clean_weather(raw)
