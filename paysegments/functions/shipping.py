"""Sending task functions to executors that do not have this package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_by_value(module_name: str) -> None:
    """Let tasks carry the module's functions instead of importing the module.

    A job then runs on any executor with NumPy and Arrow, wherever the driver
    was started and whether or not the package was handed to ``--py-files``.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
