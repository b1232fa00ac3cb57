"""Registered queries and the SQL each is checked against."""

from importlib import import_module

SECTIONS = [
    "tables", "account", "state", "history", "encoding", "policy", "evaluation", "experiments",
    "models", "audits", "exploration",
]


def load() -> None:
    for name in SECTIONS:
        import_module(f"txnlens.plans.{name}")
