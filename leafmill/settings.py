"""Settings as a JSON file of the driver: defaults, values kept over versions, and a save that can't leave half a file."""

from __future__ import annotations

import json
import os
import tempfile

DEFAULTS = {
    "output_format": "Markdown", "markdown_flavor": "GFM", "use_subfolder": True, "overwrite": False, "confidence": True, "pages": True, "toc": True, "front_matter": False,
    "headers": True, "blanks": True, "code": True, "numbers": True, "notes": True, "math": True, "language": "English", "rules_profile": "",
}
#: Values of earlier versions and what they are now.
RENAMED = {("output_format", "RAG"): "AI-Ready Chunks", ("output_format", "Text"): "Plain Text", ("language", "auto"): "Auto-detect"}


def load(path: str) -> dict:
    """Defaults with what the file holds of known keys; without a file, or with one that is no JSON object, the defaults alone."""
    try:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
    except (OSError, ValueError):
        held = {}
    known = {k: v for k, v in held.items() if k in DEFAULTS} if isinstance(held, dict) else {}
    return DEFAULTS | {k: RENAMED.get((k, v), v) if isinstance(v, str) else v for k, v in known.items()}


def save(path: str, values: dict) -> None:
    """Known keys in order, written beside the file and put in its place at once."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, beside = tempfile.mkstemp(dir=folder, suffix=".part")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump({k: values[k] for k in sorted(values) if k in DEFAULTS}, f, ensure_ascii=False, indent=2)
            f.flush()
            os.fsync(f.fileno())
        os.replace(beside, path)
    except BaseException:
        os.unlink(beside)
        raise
