"""Scale primitives shared by all operators."""

from pairloom.plans.components import components
from pairloom.plans.lineage import cut_lineage
from pairloom.plans.ordering import (
    hash_order,
    hash_rank,
    ordered_prefix,
    quantiles,
    seed_long,
    top_per_group,
    with_quantiles,
)

__all__ = [
    "components",
    "cut_lineage",
    "hash_order",
    "hash_rank",
    "ordered_prefix",
    "quantiles",
    "seed_long",
    "top_per_group",
    "with_quantiles",
]
