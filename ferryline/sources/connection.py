"""Where a server is and how to reach it: connection texts, transport security, a first probe."""

from __future__ import annotations

import re
import socket
from dataclasses import dataclass, field, replace
from pathlib import Path
from urllib.parse import parse_qsl, quote, unquote, urlsplit

DEFAULT_PORT, PING_SECONDS = 3306, 5
SCHEMES = ("mysql", "mariadb")
_DRIVER = re.compile(r"^(?:(?P<user>[^:@/]*)(?::(?P<password>.*))?@)?(?:(?P<net>[a-z0-9]+)(?:\((?P<addr>[^)]*)\))?)?/(?P<db>[^?]*)(?:\?(?P<params>.*))?$")


@dataclass
class Target:
    """One server and database."""

    host: str
    port: int = DEFAULT_PORT
    user: str = ""
    password: str = ""
    database: str = ""
    scheme: str = "mysql"
    tls: str = ""
    params: dict[str, str] = field(default_factory=dict)
    unix: bool = False

    @classmethod
    def parse(cls, raw: str) -> Target:
        """From ``mysql://user:password@host:port/db?..`` or ``user:password@tcp(host:port)/db?..``."""
        text = raw.strip()
        if not text:
            raise ValueError("dsn is empty")
        if "://" in text:
            u = urlsplit(text)
            scheme = u.scheme.lower()
            if scheme not in SCHEMES:
                raise ValueError(f"unsupported scheme {u.scheme!r}")
            if not u.hostname:
                raise ValueError("dsn host is empty")
            params = dict(parse_qsl(u.query))
            return cls(u.hostname, u.port or DEFAULT_PORT, unquote(u.username or ""), unquote(u.password or ""), u.path.removeprefix("/"), scheme, params.pop("tls", ""), params)
        m = _DRIVER.match(text)
        if not m:
            raise ValueError("unsupported DSN format")
        params = dict(parse_qsl(m["params"] or ""))
        net, addr = m["net"] or "tcp", m["addr"] or ""
        if net == "unix":
            return cls(addr, 0, m["user"] or "", m["password"] or "", m["db"], tls=params.pop("tls", ""), params=params, unix=True)
        host, _, port = addr.rpartition(":") if re.search(r":\d+$", addr) else (addr, "", "")
        return cls((host or "127.0.0.1").strip("[]"), int(port or DEFAULT_PORT), m["user"] or "", m["password"] or "", m["db"], tls=params.pop("tls", ""), params=params)

    def normal(self) -> str:
        """The driver form, parameters in order."""
        who = f"{self.user}{':' + self.password if self.password else ''}@" if self.user else ""
        host = f"[{self.host}]" if ":" in self.host else self.host
        where = f"unix({self.host})" if self.unix else f"tcp({host}:{self.port})"
        params = {**self.params, **({"tls": self.tls} if self.tls else {})}
        tail = "&".join(f"{k}={quote(v, safe='')}" for k, v in sorted(params.items()))
        return f"{who}{where}/{self.database}" + (f"?{tail}" if tail else "")

    def jdbc(self) -> dict[str, str]:
        """Options for ``spark.read.format("jdbc")``."""
        mode = {"": "", "false": "DISABLED", "true": "VERIFY_IDENTITY", "preferred": "PREFERRED"}.get(self.tls, "")
        host = f"[{self.host}]" if ":" in self.host else self.host
        return {"url": f"jdbc:{self.scheme}://{host}:{self.port}/{self.database}", "user": self.user, "password": self.password, **({"sslMode": mode} if mode else {}), **self.params}


def redacted(raw: str) -> str:
    """A connection text without its password; what is none stays as it is."""
    try:
        t = Target.parse(raw)
    except ValueError:
        return raw
    if not t.password:
        return raw
    if "://" in raw:
        return re.sub(r"^([A-Za-z]+://[^:@/]*):.*@(?=[^@]*$)", r"\1:***@", raw.strip())
    t.password = "***"
    return t.normal()


def with_tls(target: Target, mode: str, ca_file: str = "", cert_file: str = "", key_file: str = "") -> Target:
    """``target`` under a transport policy: ``disabled``, ``preferred`` or ``required``, with files of its own where given."""
    mode, files = mode.strip().lower(), [f.strip() for f in (ca_file, cert_file, key_file)]
    if not mode:
        return target
    target = replace(target, params=dict(target.params))
    if mode == "disabled":
        if any(files):
            raise ValueError("tls-mode=disabled cannot be used with --ca-file/--cert-file/--key-file")
        target.tls = "false"
        return target
    if mode not in ("preferred", "required"):
        raise ValueError(f"invalid tls mode {mode!r}")
    target.tls = "true" if mode == "required" else "preferred"
    if files[0] and "BEGIN CERTIFICATE" not in Path(files[0]).read_text():
        raise ValueError("parse ca-file: no certificates found")
    if bool(files[1]) != bool(files[2]):
        raise ValueError("both --cert-file and --key-file are required for client TLS auth")
    for name, f in zip(("serverSslCert", "clientCert", "clientKey"), files):
        if f:
            target.params[name] = f
    return target


def ping(target: Target, seconds: float = PING_SECONDS) -> None:
    """Fail soon where no server listens."""
    with socket.create_connection((target.host, target.port), seconds):
        pass


def log_client(target: Target, server_id: int) -> dict[str, str]:
    """Options of a reader of the server's change log: TCP only, the flavour by the scheme."""
    if target.unix:
        raise ValueError("the change log is read over TCP")
    return {"host": target.host, "port": str(target.port), "user": target.user, "password": target.password, "flavor": target.scheme, "server_id": str(server_id or 1001), "tls": target.tls}
