"""The registered queries: importing this package fills the registry."""

from cadenza.plans import evaluation, flows, pictures, signals, tracking  # noqa: F401
from cadenza.plans.registry import QUERIES, SQL  # noqa: F401
