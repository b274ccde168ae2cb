import importlib
import pkgutil

from staycheck.catalog.registry import ORACLES, QUERIES


def load():
    """Import every module of this folder and return the registered queries and their SQL."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return QUERIES, ORACLES
