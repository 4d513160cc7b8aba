"""All registered queries."""

from shotgrove.plans import (  # noqa: F401
    catalog_encoding, catalog_examples, catalog_fewshot, catalog_fusion, catalog_metrics, catalog_retrieval,
    catalog_sampling)
from shotgrove.plans.registry import QUERIES, SQL  # noqa: F401
