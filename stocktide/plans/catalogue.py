"""All registered queries of the engine."""

from . import q_dashboard, q_forecast, q_models, q_panel, q_report, q_stock, q_streaming, q_tree  # noqa: F401
from .registry import BODIES, QUERIES, oracle

ORACLES: dict[str, str] = {name: oracle(body) for name, body in BODIES.items() if name in QUERIES}
