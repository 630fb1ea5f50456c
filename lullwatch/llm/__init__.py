"""Training-data operators and their registered queries; nothing else in the library imports this subpackage."""

from importlib import import_module

MODULES = ("simhash", "chat", "bpe", "quality", "shards", "tokenfile", "decontaminate", "syncmers", "pages", "substrings", "alignment", "turntrie", "private")


def load_queries() -> tuple[dict, dict]:
    """Import every operator's module; return the registered queries and their SQL texts."""
    from lullwatch.llm import common

    for name in MODULES:
        import_module(f"lullwatch.llm.{name}")
    return dict(common.QUERIES), dict(common.ORACLES)
