"""Configuration files: ``group``/``key = value``, merged in name order, with ``${key}`` expansion."""

from __future__ import annotations

import configparser
import os
import re

MAX_EXPANSIONS = 10


def load(folder: str, overrides: dict[str, str] | None = None) -> dict[str, str]:
    """``group.key`` to value from all ``*.conf`` of a folder, later files and then the overrides winning."""
    found: dict[str, str] = {}
    for name in sorted((n for n in os.listdir(folder) if n.lower().endswith(".conf")), key=str.lower):
        parser = configparser.RawConfigParser(strict=False)
        parser.optionxform = str
        parser.read(os.path.join(folder, name), encoding="utf-8")
        for group in parser.sections():
            found.update({f"{group}.{k}": v for k, v in parser.items(group)})
    return found | (overrides or {})


def get(config: dict[str, str], group: str, key: str, default: str | None = None) -> str | None:
    """The value of the group, else of ``general``, else the default, expanded."""
    raw = config.get(f"{group}.{key}", config.get(f"general.{key}"))
    if raw is None:
        return default
    for _ in range(MAX_EXPANSIONS):
        new = re.sub(r"\$\{([^}]+)\}", lambda m: config.get(f"{group}.{m[1]}", config.get(f"general.{m[1]}", m[0])), raw)
        if new == raw:
            break
        raw = new
    return raw


#: What a group's name begins with, before the classifier's own name (fixed value).
PREFIX = "subcontractor_"


def options(config: dict[str, str]) -> dict:
    """Arguments of ``api.classify`` that a configuration gives: block size, first block, style, and the registry with
    precedence, confidence thresholds and time limits of the classifiers. Fixed names; others are left out.

    A classifier's own group goes before ``general``; a time of -1 (milliseconds) is no end, a precedence list names all
    that come first, in order.
    """
    from strata.operators.classifiers import THRESHOLD, TIMEOUT, TIMEOUTS, Limits, Registry

    number = lambda key, default: int(get(config, "general", key, str(default)))
    names = sorted({g.removeprefix(PREFIX) for g in (k.split(".")[0] for k in config) if g.startswith(PREFIX)})
    order = [n.strip().removeprefix(PREFIX) for n in (get(config, "general", "subcontractor_precedence", "") or "").split(",") if n.strip()]
    own = {n: config.get(f"{PREFIX}{n}.subcontractor_confidence_threshold") for n in names}
    times = {n: config.get(f"{PREFIX}{n}.subcontractor_timeout") for n in names}
    seconds = lambda ms: None if int(ms) < 0 else int(ms) / 1000
    base = Registry(thresholds={n: int(v) for n, v in own.items() if v is not None and int(v) >= 0}, threshold=number("subcontractor_confidence_threshold", THRESHOLD))
    if order:
        base = Registry(precedence=tuple(order), thresholds=base.thresholds, threshold=base.threshold)
    limits = Limits(timeouts=TIMEOUTS | {n: seconds(v) for n, v in times.items() if v is not None}, timeout=seconds(get(config, "general", "subcontractor_timeout", str(int(TIMEOUT * 1000)))))
    return {"block_size": number("block_size", 512), "start_block": number("starting_block", 0), "style": number("output_style", 0), "reg": base, "limits": limits}
