"""Settings from mappings and files: later ones win, missing ones are skipped."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping

DEFAULTS = {"default_section": "body", "format": "json", "compression": "bz2", "layout": "stubbytree"}
#: Where settings are looked for, in this order.
FILES = ("/etc/folio.yaml", "~/.config/folio.yaml", "folio.yaml")


def load(*settings: Mapping | None) -> dict:
    out = dict(DEFAULTS)
    for s in settings:
        out |= s or {}
    return out


def _plain_yaml(text: str) -> dict:
    """One level of ``key: value`` lines, for where no YAML library is installed."""
    words = {"null": None, "~": None, "": None, "true": True, "false": False}
    out = {}
    for line in text.splitlines():
        if m := re.match(r"(\w+)\s*:\s*(.*?)\s*(?:#.*)?$", line):
            value = m[2].strip("'\"")
            out[m[1]] = words.get(value.lower(), value) if value == m[2] else value
    return out


def read_file(path: str) -> dict:
    """The settings of a YAML or JSON file; none where there is no such file."""
    path = os.path.expanduser(path)
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text) or {}
    try:
        import yaml
    except ImportError:
        return _plain_yaml(text)
    return yaml.safe_load(text) or {}


def load_files(*paths: str, **settings) -> dict:
    """Settings of the files (by default :data:`FILES`) over the defaults, and ``settings`` over both."""
    return load(*(read_file(p) for p in paths or FILES), {k: v for k, v in settings.items() if v is not None})


def learn(path: str) -> dict:
    """``format`` and ``compression`` as a volume file's name tells them."""
    name = os.path.basename(path)
    found = re.search(r"\.(json|parquet)(?:\.(bz2|gz))?$", name)
    if not found:
        raise ValueError(f"neither .json nor .parquet: {name}")
    return {"format": found[1], "compression": "snappy" if found[1] == "parquet" else found[2]}
