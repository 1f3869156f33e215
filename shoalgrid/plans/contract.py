"""All contract queries."""

from shoalgrid.plans import contract_cells, contract_points, contract_maps, contract_models, contract_more, contract_selection, contract_tides  # noqa: F401
from shoalgrid.plans.registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
