"""Named queries over the driver's tables."""

from importlib import import_module

from .. import registry

_MODULES = ["window_queries", "relational_queries", "model_queries", "feed_queries", "more_queries", "source_queries", "validation_queries", "latent_queries", "study_queries", "tail_queries", "likelihood_queries", "fan_queries", "cluster_queries", "live_queries", "version_queries", "registry_queries"]


def _load() -> None:
    for name in _MODULES:
        import_module(f"{__name__}.{name}")


def queries() -> dict[str, registry.Query]:
    _load()
    return registry.QUERIES


def oracles() -> dict[str, str]:
    _load()
    return registry.ORACLES
