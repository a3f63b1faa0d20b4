"""Objects kept by Python workers: a model is built once per worker process
and found again by the content of its factory, so two factories never share
a model.  Functions here are imported by the workers, not shipped by value,
so their module's table is the worker's own."""
from __future__ import annotations

import hashlib

from pyspark import cloudpickle

_KEPT: dict = {}


def factory_key(factory) -> str:
    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


def kept(key: str, factory):
    """The worker's object for ``key``, made by ``factory()`` at first use."""
    if key not in _KEPT:
        _KEPT[key] = factory()
    return _KEPT[key]


def kept_last(kind: str, key: str, factory):
    """As :func:`kept`, but only the last object of ``kind`` stays."""
    if _KEPT.get(kind, (None,))[0] != key:
        _KEPT[kind] = (key, factory())
    return _KEPT[kind][1]
