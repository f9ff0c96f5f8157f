"""Durable state on the driver: private atomic files, a single-writer lock, settings, artifacts with defaults, typed cursors."""

from __future__ import annotations

import base64
import datetime as dt
import json
import os
import random
import re
import time
import uuid
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def private_folder(path: str | Path) -> Path:
    """The folder, made for its owner alone where it is not there."""
    p = Path(path)
    p.mkdir(parents=True, exist_ok=True, mode=0o700)
    return p


def write_private(path: str, text: str) -> None:
    """Write beside the target, flush, and move into place; readers see the old file or the new one."""
    target = Path(path)
    private_folder(target.parent)
    part = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    fd = os.open(part, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
    with os.fdopen(fd, "w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, target)


class DirLock:
    """One writer for a state directory; the file tells who holds it."""

    def __init__(self, folder: str):
        self.path = Path(folder) / "lock"

    def __enter__(self):
        private_folder(self.path.parent)
        try:
            fd = os.open(self.path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
        except FileExistsError:
            raise RuntimeError(f"state is locked by {self.path.read_text()}; remove {self.path} if that run is gone") from None
        with os.fdopen(fd, "w") as f:
            json.dump({"pid": os.getpid(), "since": time.time()}, f)
        return self

    def __exit__(self, *_):
        self.path.unlink(missing_ok=True)


@dataclass
class Settings:
    source: str = ""
    dest: str = ""
    state_dir: str = "state"
    databases: str = ""
    exclude_databases: str = ""
    chunk_rows: int = 1000
    concurrency: int = 4
    conflict_policy: str = "fail"
    apply_ddl: str = "warn"
    max_events: int = 0
    max_lag_seconds: int = 0
    rate_limit: int = 0
    downgrade_profile: str = "strict-lts"
    tls_mode: str = ""

    @classmethod
    def load(cls, text: str, **flags) -> Settings:
        """Settings from JSON or from ``name: value`` lines; unknown names and trailing content are refused, flags that are given win."""
        found = json.loads(text) if text.lstrip().startswith("{") else _lines(text)
        known = {f.name: f.type for f in fields(cls)}
        found = {k.replace("-", "_"): v for k, v in found.items()}
        if unknown := sorted(set(found) - set(known)):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        out = cls(**found | {k: v for k, v in flags.items() if v is not None})
        for name, kind in known.items():
            if kind == "int":
                setattr(out, name, int(getattr(out, name)))
        return out

    def check(self) -> Settings:
        if self.concurrency < 1 or self.chunk_rows < 1:
            raise ValueError("concurrency and chunk rows must be 1 or more")
        if self.conflict_policy not in ("fail", "source-wins", "dest-wins"):
            raise ValueError(f"invalid conflict policy {self.conflict_policy!r}")
        if self.apply_ddl not in ("ignore", "warn", "apply"):
            raise ValueError(f"invalid apply-ddl {self.apply_ddl!r}")
        if min(self.max_events, self.max_lag_seconds, self.rate_limit) < 0:
            raise ValueError("limits must not be negative")
        return self


def _lines(text: str) -> dict[str, str]:
    out = {}
    for line in text.splitlines():
        line = line.split(" #")[0].strip()
        if not line or line.startswith("#") or line == "---":
            continue
        name, colon, value = line.partition(":")
        if not colon or name.strip() in out:
            raise ValueError(f"cannot read setting {line!r}")
        out[name.strip()] = value.strip().strip("'\"")
    return out


# Artifacts: documents with defaults, each in a file of its name.
ARTIFACTS = {
    "data-baseline-checkpoint": {"version": 1, "tables": {}, "source_watermark_file": "", "source_watermark_pos": 0},
    "replication-checkpoint": {"version": 1, "binlog_file": "", "binlog_pos": 0, "gtid_set": "", "apply_ddl": "warn", "updated_at": ""},
    "replication-conflict-report": {"version": 1, "failure_type": "", "applied_end_file": "", "applied_end_pos": 0, "values_redacted": False, "value_sample": [], "old_row_sample": [], "new_row_sample": [], "row_diff_sample": [], "generated_at": ""},
    "cdc-checkpoint": {"version": 1, "databases": {}},
    "verify-data-report": {"version": 1, "data_mode": "", "summary": {}},
    "collation-precheck": {"version": 1, "findings": []},
    "plugin-lifecycle-precheck": {"version": 1, "findings": []},
    "invisible-gipk-precheck": {"version": 1, "findings": []},
}


def now() -> str:
    return dt.datetime.now(dt.UTC).isoformat().replace("+00:00", "Z")


def artifact_path(folder: str, name: str) -> Path:
    if name not in ARTIFACTS:
        raise ValueError(f"no such artifact: {name}")
    return Path(folder) / f"{name}.json"


def load_artifact(folder: str, name: str) -> dict | None:
    """The document with defaults for what it lacks, or None where there is none."""
    path = artifact_path(folder, name)
    if not path.exists():
        return None
    found = ARTIFACTS[name] | json.loads(path.read_text())
    if name == "data-baseline-checkpoint":  # cursors of earlier versions were texts
        for entry in found["tables"].values():
            if entry.get("last_key") and not entry.get("cursor"):
                entry["cursor"] = [encode_cursor(v) for v in entry.pop("last_key")]
    return found


def save_artifact(folder: str, name: str, document: dict) -> None:
    write_private(str(artifact_path(folder, name)), json.dumps(ARTIFACTS[name] | document, indent=2, sort_keys=True))


def drop_artifact(folder: str, name: str) -> None:
    artifact_path(folder, name).unlink(missing_ok=True)


def server_id(folder: str, explicit: int = 0) -> int:
    """The identity of a log reader: as given, else random and kept in the folder."""
    if explicit:
        return explicit
    path = Path(folder) / "server-id.json"
    if path.exists():
        return int(json.loads(path.read_text())["server_id"])
    found = random.SystemRandom().randrange(100_000, 2**32 - 1)
    write_private(str(path), json.dumps({"server_id": found}))
    return found


def resume_position(manifest: dict | None, local: dict | None, explicit: tuple[str, int] | None) -> tuple[str, int] | None:
    """Where a run starts: the destination's own checkpoint, else the local file's, else what was asked for; positions below 4 are 4."""
    for c in (manifest, local):
        if c and c.get("binlog_file"):
            return c["binlog_file"], max(4, int(c.get("binlog_pos", 0)))
    return (explicit[0], max(4, explicit[1])) if explicit else None


def encode_cursor(value) -> dict:
    """One key value with its type."""
    kinds = ((bool, "bool"), (int, "int64"), (float, "float64"), (str, "string"))
    if value is None:
        return {"type": "null"}
    if isinstance(value, (bytes, bytearray)):
        return {"type": "bytes", "value": base64.b64encode(bytes(value)).decode()}
    if isinstance(value, dt.datetime):
        return {"type": "time", "value": value.isoformat()}
    if isinstance(value, dt.date):
        return {"type": "date", "value": value.isoformat()}
    for kind, name in kinds:
        if isinstance(value, kind):
            return {"type": "uint64" if name == "int64" and value >= 2**63 else name, "value": str(value).lower() if name == "bool" else repr(value) if name == "float64" else str(value)}
    if type(value).__name__ == "Decimal":
        return {"type": "decimal", "value": str(value)}
    raise TypeError(f"unsupported cursor value type {type(value).__name__}")


def decode_cursor(stored: dict):
    from decimal import Decimal

    readers = {"null": lambda v: None, "bytes": base64.b64decode, "time": dt.datetime.fromisoformat, "date": dt.date.fromisoformat, "bool": lambda v: v == "true", "int64": int, "uint64": int, "float64": float, "string": str, "decimal": Decimal}
    if stored.get("type") not in readers:
        raise ValueError(f"unsupported cursor type {stored.get('type')!r}")
    return readers[stored["type"]](stored.get("value"))


def redact_url(url: str) -> str:
    return re.sub(r"^((?:[a-z]+://)?[^:/@]+):[^@]*@", r"\1:<redacted>@", url)


def redact_pair(text: str) -> str:
    """The value of ``k=v`` or ``k:v`` goes, from the first separator of either kind on."""
    return re.sub(r"^([^=:]*[=:]).*$", r"\1<redacted>", text, flags=re.S)


def changes_between(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A change log from two snapshots: (keys, operation, old_row, new_row), rows as JSON with nulls kept."""
    image = lambda df: F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    a = old.select(*keys, image(old).alias("old_row"))
    b = new.select(*keys, image(new).alias("new_row"))
    operation = F.when(F.col("old_row").isNull(), "insert").when(F.col("new_row").isNull(), "delete").otherwise("update")
    return a.join(b, keys, "full_outer").filter(~F.col("old_row").eqNullSafe(F.col("new_row"))).withColumn("operation", operation)
