"""Documents of a store: canonical JSON, strict readers, signatures, and a folder that holds them."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import tomllib
import unicodedata
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any

from tracelight.functions.signing import public_key, sign, verify


class DocumentError(ValueError):
    pass


# -- canonical JSON --------------------------------------------------------------------------------


def _check(value: Any, path: str = "$") -> None:
    if isinstance(value, float):
        raise DocumentError(f"a number that is no integer at {path}")
    if isinstance(value, dict):
        for k, v in value.items():
            if not isinstance(k, str):
                raise DocumentError(f"a key that is no string at {path}")
            _check(v, f"{path}.{k}")
    elif isinstance(value, (list, tuple)):
        for i, v in enumerate(value):
            _check(v, f"{path}[{i}]")
    elif not (value is None or isinstance(value, (bool, int, str))):
        raise DocumentError(f"{type(value).__name__} at {path}")


def canonical_json(value: Any) -> bytes:
    """Sorted keys, no blanks, integers only, and escapes only where they must be."""
    _check(value)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def is_canonical(data: bytes) -> bool:
    try:
        return canonical_json(json.loads(data)) == data
    except ValueError:
        return False


def normalized_keys(value: Any) -> Any:
    """Keys in normal form C, in order."""
    if isinstance(value, dict):
        return {k: normalized_keys(v) for k, v in sorted((unicodedata.normalize("NFC", k), v) for k, v in value.items())}
    if isinstance(value, list):
        return [normalized_keys(v) for v in value]
    return value


def strict_json(data: bytes | str, schema: str, keys: dict[str, type | tuple]) -> dict:
    """A document of one schema: known keys only, all of them, each of its type."""
    try:
        value = json.loads(data)
    except ValueError as e:
        raise DocumentError(f"not JSON: {e}") from e
    if not isinstance(value, dict) or value.get("schema") != schema:
        raise DocumentError(f"not a document of schema {schema}")
    own = {"schema": str, **keys}
    if unknown := sorted(set(value) - set(own)):
        raise DocumentError(f"unknown fields {unknown}")
    if missing := sorted(set(own) - set(value)):
        raise DocumentError(f"missing fields {missing}")
    for k, t in own.items():
        if not isinstance(value[k], t) or (t is int and isinstance(value[k], bool)):
            raise DocumentError(f"field {k} has the wrong type")
    return value


def signed(value: dict, seed: bytes) -> dict:
    """The document with a signature over its canonical form."""
    body = {k: v for k, v in value.items() if k != "signature"}
    return body | {"signature": base64.b64encode(sign(seed, canonical_json(body))).decode()}


def is_signed(value: dict, key: bytes) -> bool:
    body = {k: v for k, v in value.items() if k != "signature"}
    try:
        return verify(key, canonical_json(body), base64.b64decode(value.get("signature", ""), validate=True))
    except ValueError:
        return False


# -- configuration ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Config:
    """Settings of a project; the values are checked when it is made."""

    targets: tuple[str, ...] = ("src",)
    excludes: tuple[str, ...] = ()
    target_sites: int = 24
    tag_bits: int = 4
    embed_strings: bool = True

    def __post_init__(self):
        if not self.targets or any(t.startswith("/") or ".." in t.split("/") for t in self.targets):
            raise DocumentError("targets are relative folders below the project")
        if not 2 <= self.tag_bits <= 8:
            raise DocumentError("tag_bits is 2 to 8")
        if not 8 <= self.target_sites <= 4096:
            raise DocumentError("target_sites is 8 to 4096")

    @classmethod
    def parse(cls, text: str) -> Config:
        table = tomllib.loads(text)
        if unknown := sorted(set(table) - {"protect"}):
            raise DocumentError(f"unknown tables {unknown}")
        own = table.get("protect", {})
        names = {f.name for f in fields(cls)}
        if unknown := sorted(set(own) - names):
            raise DocumentError(f"unknown settings {unknown}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in own.items()})

    def toml(self) -> str:
        spell = lambda v: json.dumps(list(v) if isinstance(v, tuple) else v)
        return "[protect]\n" + "".join(f"{f.name} = {spell(getattr(self, f.name))}\n" for f in fields(self))


# -- the store -------------------------------------------------------------------------------------

_NAME = re.compile(r"^[A-Za-z0-9_-][A-Za-z0-9._-]{0,119}$")


class Store:
    """A folder with a private and a public part.  Files are written beside and moved into place."""

    FOLDER = ".store"

    def __init__(self, root: str | Path):
        self.root = Path(root)
        self.path = self.root / self.FOLDER

    @classmethod
    def init(cls, root: str | Path, config: Config = Config()) -> Store:
        store = cls(root)
        for part in ("private", "public/releases", "public/reports"):
            (store.path / part).mkdir(parents=True, exist_ok=True)
        if not (store.path / "config.toml").exists():
            store._write(store.path / "config.toml", config.toml().encode())
        ignore = store.root / ".gitignore"
        lines = ignore.read_text().splitlines() if ignore.exists() else []
        if f"{cls.FOLDER}/private/" not in lines:
            store._write(ignore, ("\n".join([*lines, f"{cls.FOLDER}/private/"]) + "\n").encode())
        return store

    @classmethod
    def discover(cls, start: str | Path) -> Store:
        """The store of the folder or of the nearest folder above it."""
        for folder in (Path(start).resolve(), *Path(start).resolve().parents):
            if (folder / cls.FOLDER / "config.toml").exists():
                return cls(folder)
        raise DocumentError(f"no store at or above {start}")

    @staticmethod
    def _write(path: Path, data: bytes, private: bool = False) -> None:
        path.parent.mkdir(parents=True, exist_ok=True)
        beside = path.with_name(path.name + f".{os.getpid()}.new")
        with open(os.open(beside, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600 if private else 0o644), "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(beside, path)
        if path.read_bytes() != data:
            raise DocumentError(f"{path} does not hold what was written")

    def config(self) -> Config:
        return Config.parse((self.path / "config.toml").read_text())

    def write_secret(self, root: bytes) -> None:
        digest = hashlib.sha256(root).hexdigest()[:16]
        self._write(self.path / "private" / "root.json", canonical_json({"schema": "root-1", "scheme": "plain", "secret": root.hex(), "check": digest}), private=True)

    def secret(self) -> bytes:
        value = strict_json((self.path / "private" / "root.json").read_bytes(), "root-1", {"scheme": str, "secret": str, "check": str})
        root = bytes.fromhex(value["secret"])
        if hashlib.sha256(root).hexdigest()[:16] != value["check"]:
            raise DocumentError("the secret does not match its check value")
        return root

    def write_release(self, release_id: str, manifest: dict, record: dict) -> None:
        """Private manifest first, public record last: a record promises a manifest."""
        if not re.fullmatch(r"rel-[a-z2-7]{1,32}", release_id):
            raise DocumentError(f"{release_id} is no release id")
        if self.record_path(release_id).exists():
            raise DocumentError(f"release {release_id} exists already")
        self._write(self.path / "private" / "manifests" / f"{release_id}.json", canonical_json(manifest), private=True)
        self._write(self.record_path(release_id), canonical_json(record))

    def record_path(self, release_id: str) -> Path:
        return self.path / "public" / "releases" / f"{release_id}.json"

    def releases(self) -> list[str]:
        return sorted(p.stem for p in (self.path / "public" / "releases").glob("*.json"))

    def record(self, release_id: str) -> dict:
        try:
            return json.loads(self.record_path(release_id).read_bytes())
        except FileNotFoundError as e:
            raise DocumentError(f"no release {release_id}") from e

    def manifest(self, release_id: str) -> dict:
        try:
            return json.loads((self.path / "private" / "manifests" / f"{release_id}.json").read_bytes())
        except FileNotFoundError as e:
            raise DocumentError(f"no manifest of release {release_id}") from e

    def save_report(self, stem: str, report: dict) -> str:
        """Its name; a number is put behind a stem that is taken."""
        if not _NAME.match(stem):
            raise DocumentError(f"{stem} is no name for a report")
        folder, name, n = self.path / "public" / "reports", stem, 1
        while (folder / f"{name}.json").exists():
            n += 1
            name = f"{stem}-{n}"
        self._write(folder / f"{name}.json", canonical_json(report))
        return name

    def reports(self) -> list[str]:
        """Names, newest first."""
        return sorted((p.stem for p in (self.path / "public" / "reports").glob("*.json")), reverse=True)

    def report(self, name: str) -> dict:
        stem = re.split(r"[/\\]", name)[-1].removesuffix(".json")
        return json.loads((self.path / "public" / "reports" / f"{stem}.json").read_bytes())

    def inventory(self) -> list[tuple[str, str]]:
        """(path, visibility) of every document."""
        out = []
        for p in sorted(self.path.rglob("*")):
            if p.is_file():
                rel = p.relative_to(self.path).as_posix()
                out.append((rel, "public" if rel.startswith("public/") else "config" if rel == "config.toml" else "private"))
        return out


def verify_key(seed: bytes) -> str:
    return base64.b64encode(public_key(seed)).decode()
