"""Registered queries. Importing the modules fills the registry."""

from __future__ import annotations

import importlib

from .registry import REGISTRY

MODULES = ["flagship", "ingest", "labels", "series", "matrix", "splits", "anomaly", "models", "metrics",
           "clusters", "attribution", "probes", "overview", "streams", "bundles", "sketches", "proposals"]


def load_all():
    for m in MODULES:
        importlib.import_module(f"faultspark.plans.{m}")
    return REGISTRY
