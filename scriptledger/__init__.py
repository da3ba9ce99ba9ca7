"""Payments-to-prescribers and prescribing-volume analytics as Spark DataFrames.

Layers, bottom up: ``sources`` (files, load filters, sinks), ``functions``
(Column helpers and fixed rule lists), ``operators`` (reusable DataFrame
building blocks) and ``plans`` (staging, intermediate and mart models, the
analyses, the parameterised views and the batch build).
"""

from scriptledger.plans.warehouse import Warehouse
from scriptledger.session import build_session

__all__ = ["Warehouse", "build_session"]
