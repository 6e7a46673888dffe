"""Every query of the library by name, with its SQL where there is one."""

from __future__ import annotations

from . import audits, bars, evaluation, experiments, features, inputs, joins, levels, models, momentum, recursion, scalars, streams, texts, training, windows  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401

FLAGSHIP = "gold_features_daily"
