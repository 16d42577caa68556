"""Settings of an index and its searches: one record, checked and repaired key by key."""

from __future__ import annotations

import math

VERSION = 5

# Keys with their defaults; numbers with their bounds; texts with their choices.
FLAGS = {"automaticSuggestions": True, "lexicalMatchingEnabled": True, "semanticIndexingEnabled": False, "semanticModelEnabled": False, "semanticModelInstalled": False}
WHOLE_NUMBERS = {"backgroundEmbeddingBatchLimit": (4, 4, 16), "debounceMs": (350, 100, 2000), "maxSuggestions": (6, 1, 20)}
SHARES = {"minimumConfidence": (0.55, 0.0, 1.0)}
CHOICES = {"linkPathMode": ("shortest", "full")}
LISTS = ("excludedFolders", "excludedFiles", "excludedTags", "excludedProperties")
FLAG, OLD_NAMES = "semanticIndexingEnabled", ("semanticMatchingEnabled", "enableSemanticSearch")
THREAD_COUNTS = (0, 1, 2, 4)
DEVICE_CLASSES = ("unknown", "1-2", "3-4", "5-8", "9+")
AUTOMATIC = {"semanticThreadMode": "automatic", "semanticThreadCount": 0, "semanticThreadModelRevision": "", "semanticThreadRuntimeVersion": "", "semanticThreadDeviceClass": "unknown"}


def _number(value, default: float, low: float, high: float) -> float:
    good = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
    return min(high, max(low, value)) if good else default


def _texts(value) -> list[str]:
    """Distinct trimmed texts of a list, in order."""
    return list(dict.fromkeys(x.strip() for x in value if isinstance(x, str) and x.strip())) if isinstance(value, list) else []


def _threads(raw: dict) -> dict:
    """A tuned profile counts only if it is complete."""
    own = {k: raw.get(k) for k in AUTOMATIC}
    named = all(isinstance(own[k], str) and own[k] for k in ("semanticThreadModelRevision", "semanticThreadRuntimeVersion", "semanticThreadDeviceClass"))
    sound = own["semanticThreadMode"] == "tuned" and own["semanticThreadCount"] in THREAD_COUNTS[1:] and named and own["semanticThreadDeviceClass"] in DEVICE_CLASSES[1:]
    return own if sound else dict(AUTOMATIC)


def load(raw: object) -> tuple[dict, bool]:
    """Settings from any stored value, and whether they differ from it and should be saved. Newer versions are read but not saved."""
    source = raw if isinstance(raw, dict) else {}
    out: dict = {"settingsVersion": VERSION}
    source = source | {FLAG: next((source[k] for k in (FLAG, *OLD_NAMES) if isinstance(source.get(k), bool)), None)}
    out |= {k: source[k] if isinstance(source.get(k), bool) else v for k, v in FLAGS.items()}
    if not isinstance(source.get("semanticModelEnabled"), bool):
        out["semanticModelEnabled"] = True
    out["semanticModelEnabled"] = out["semanticModelInstalled"] and out["semanticModelEnabled"]
    out |= _threads(source)
    out |= {k: math.floor(_number(source.get(k), *of) + 0.5) for k, of in WHOLE_NUMBERS.items()}
    out |= {k: _number(source.get(k), *of) for k, of in SHARES.items()}
    out |= {k: _texts(source.get(k)) for k in LISTS}
    out["excludedTags"] = list(dict.fromkeys(t for x in out["excludedTags"] if (t := x.lstrip("#").strip().lower())))
    out["excludedProperties"] = list(dict.fromkeys(x.lower() for x in out["excludedProperties"]))
    out |= {k: source.get(k) if source.get(k) in options else options[0] for k, options in CHOICES.items()}
    version = source.get("settingsVersion")
    current = isinstance(version, int) and version > VERSION
    return out, raw is not None and not current and raw != out
