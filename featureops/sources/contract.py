"""Feature contract: a small JSON document that fixes the feature set and its column order."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..params import ENTITY_COL


@dataclass(frozen=True)
class Contract:
    feature_set: str
    columns: tuple[str, ...]
    fingerprint: str
    document: str


def faults(doc: object, feature_set: str) -> list[str]:
    """Everything that is wrong with a contract document."""
    if not isinstance(doc, dict):
        return ["the document is no object"]
    found = [] if doc.get("feature_set") == feature_set else [f"it is for {doc.get('feature_set')!r}, not {feature_set!r}"]
    entries = doc.get("columns")
    if not isinstance(entries, list):
        return [*found, "columns is no list"]
    names = [e.get("name") if isinstance(e, dict) else None for e in entries]
    found += [f"column {i + 1} has no name" for i, n in enumerate(names) if not isinstance(n, str) or not n]
    found += [f"column {n!r} occurs {k} times" for n, k in Counter(n for n in names if n).items() if k > 1]
    return found if ENTITY_COL in names else [*found, f"there is no {ENTITY_COL} column"]


def fingerprint(doc: dict) -> str:
    """Fixed form: SHA-256 of the JSON with sorted keys and no blanks, in UTF-8."""
    return hashlib.sha256(json.dumps(doc, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def parse_contract(text: str, feature_set: str) -> Contract:
    doc = json.loads(text)
    if wrong := faults(doc, feature_set):
        raise ValueError("contract: " + "; ".join(wrong))
    return Contract(feature_set, tuple(e["name"] for e in doc["columns"]), fingerprint(doc), text)


def read_contract(spark: SparkSession, path: str, feature_set: str) -> Contract:
    return parse_contract(spark.read.text(path, wholetext=True).first().value, feature_set)
