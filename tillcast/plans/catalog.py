"""Import every query module so that ``REGISTRY`` is complete."""

from tillcast.plans import q_core, q_intervals, q_lookups, q_models, q_prep, q_reports, q_scoring, q_sources, q_transforms, q_windows  # noqa: F401
from tillcast.plans import q_extra  # noqa: F401,E402  (registers aliases of the keys above)
from tillcast.plans.registry import REGISTRY, oracle


def queries():
    return {k: q.build for k, q in REGISTRY.items()}


def oracle_sql():
    out = {}
    for k, q in REGISTRY.items():
        s = oracle(q)
        if s is not None:
            out[k] = s
    return out
