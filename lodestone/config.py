"""Settings of an installation: folders, identities, the active model, the key.

All of it is read on the driver, at every call, from arguments, the environment and
one JSON file; an unreadable file counts as empty.
"""

from __future__ import annotations

import base64
import binascii
import json
import os
import uuid
from collections.abc import Callable, MutableMapping
from pathlib import Path

from lodestone.functions.ids import project_id as hashed

#: The selectable models and the length of their vectors.
MODEL_DIMS = {"nomic-embed-text-v1.5": 768, "bge-small-en-v1.5": 384, "bge-m3": 1024, "embeddinggemma-300m": 768}
KEY_BYTES = 32


def read(path: str | Path) -> dict:
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def write(path: str | Path, settings: dict) -> None:
    """Replaces the file as a whole, so that no reader sees half of it."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f"{path.name}.{uuid.uuid4().hex}")
    part.write_text(json.dumps(settings, indent=2) + "\n", encoding="utf-8")
    part.replace(path)


def store_folder(explicit: str | None = None, project_root: str | None = None) -> str:
    """Where a store's tables are: the argument, LODESTONE_STORE, or by LODESTONE_MODE (global, project; unset: the user's)."""
    if named := explicit or os.environ.get("LODESTONE_STORE"):
        return named
    mode, home = os.environ.get("LODESTONE_MODE"), Path.home() / ".lodestone"
    places = {None: home / "store", "global": home / "global", "project": Path(project_root or os.getcwd()) / ".lodestone" / "store"}
    if mode not in places:
        raise ValueError(f"LODESTONE_MODE must be global or project, got {mode!r}")
    return str(places[mode])


def project_id(path: str | None = None) -> str:
    """16 hex digits for a folder: links and dots resolved; it need not exist."""
    return hashed(Path(path or os.getcwd()).resolve().as_posix())


def client_id(path: str | Path) -> str:
    """LODESTONE_CLIENT_ID, else the file's, else a new one that the file keeps."""
    found = os.environ.get("LODESTONE_CLIENT_ID") or read(path).get("client_id")
    return found or init(path)["client_id"]


def init(path: str | Path, **settings) -> dict:
    """Writes the file; what identifies an installation stays as it was, so a second run changes nothing."""
    old = read(path)
    new = {"client_id": uuid.uuid4().hex, **old, **settings}
    new |= {k: old[k] for k in ("project_id", "created", "client_id") if old.get(k)}
    if new != old:
        write(path, new)
    return new


def active_model() -> str | None:
    """LODESTONE_MODEL; null, empty and none: search by words alone.  An unknown name is an error."""
    name = os.environ.get("LODESTONE_MODEL") or "none"
    if name.lower() == "none":
        return None
    if name not in MODEL_DIMS:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(MODEL_DIMS)}, none")
    return name


def active_dim() -> int:
    name = active_model()
    if name is None:
        raise ValueError("without a model there are no vectors")
    return MODEL_DIMS[name]


def resolve_key(project: str, cache: MutableMapping[str, bytes], derive: Callable[[], bytes]) -> bytes:
    """The project's key: LODESTONE_KEY (base64), the cached one, or a newly derived one, which the cache keeps."""
    if given := os.environ.get("LODESTONE_KEY"):
        try:
            key = base64.b64decode(given, validate=True)
        except binascii.Error as e:
            raise ValueError("LODESTONE_KEY is no base64") from e
        if len(key) != KEY_BYTES:
            raise ValueError(f"LODESTONE_KEY must hold {KEY_BYTES} bytes, got {len(key)}")
        return key
    slot = f"key:{project}"
    if len(cache.get(slot) or b"") != KEY_BYTES:
        cache[slot] = derive()
    return cache[slot]
