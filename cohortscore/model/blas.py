"""One BLAS thread on the driver: its small matrices lose more than they win by threads beside a busy JVM."""

from __future__ import annotations

import ctypes
import glob
import os

import numpy as np

SETTERS = ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads")


def one_thread() -> bool:
    """Limit the OpenBLAS that numpy ships with; False if there is none, and nothing is changed."""
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for name in SETTERS:
            if hasattr(lib, name):
                getattr(lib, name)(1)
                return True
    return False
