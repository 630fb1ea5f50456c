"""Test bed: the driver's tables as a sensor journal, and the registered checks over them."""

from importlib import import_module

CHECKS = ("checks_journal", "checks_joins", "checks_features", "checks_model", "checks_serving", "checks_advice", "checks_quality", "checks_streaming", "checks_sources")


def load_checks() -> None:
    for name in CHECKS:
        import_module(f"lullwatch.testbed.{name}")
