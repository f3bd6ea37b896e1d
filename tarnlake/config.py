"""Configuration from the environment, checked when it is built."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field


class MissingSettings(ValueError):
    """Required settings are absent; the message names every one of them."""


def read_env_file(path: str) -> dict[str, str]:
    """Parse KEY=VALUE lines; blank lines, comments and surrounding quotes are ignored."""
    found = {}
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            key, eq, value = line.strip().removeprefix("export ").partition("=")
            if eq and not key.startswith("#"):
                found[key.strip()] = value.strip().strip("\"'")
    return found


def require(names: list[str], env: Mapping[str, str] | None = None) -> dict[str, str]:
    """The named settings; raises MissingSettings listing all that are absent or empty."""
    env = os.environ if env is None else env
    if missing := [n for n in names if not env.get(n)]:
        raise MissingSettings(f"missing settings: {', '.join(missing)}")
    return {n: env[n] for n in names}


def oauth_options(account: str, tenant: str, client: str, secret: str) -> dict[str, str]:
    """Reader options for a client-credentials login to an object store account."""
    host = f"{account}.dfs.core.windows.net"
    prefix = "fs.azure.account"
    return {
        f"{prefix}.auth.type.{host}": "OAuth",
        f"{prefix}.oauth.provider.type.{host}": "org.apache.hadoop.fs.azurebfs.oauth2.ClientCredsTokenProvider",
        f"{prefix}.oauth2.client.id.{host}": client,
        f"{prefix}.oauth2.client.secret.{host}": secret,
        f"{prefix}.oauth2.client.endpoint.{host}": f"https://login.microsoftonline.com/{tenant}/oauth2/token",
    }


@dataclass(frozen=True)
class Database:
    """Where tables are published."""

    host: str
    database: str
    user: str
    password: str = field(repr=False)
    port: int = 1433
    login_timeout: int = 30
    encrypt: bool = True
    trust_certificate: bool = False
    certificate_host: str | None = None

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "DB_") -> Database:
        got = require([f"{prefix}{k}" for k in ("HOST", "DATABASE", "USER", "PASSWORD")], env)
        return cls(*got.values())

    def url(self) -> str:
        parts = {
            "databaseName": self.database,
            "encrypt": str(self.encrypt).lower(),
            "trustServerCertificate": str(self.trust_certificate).lower(),
            "hostNameInCertificate": self.certificate_host,
            "loginTimeout": self.login_timeout,
        }
        return f"jdbc:sqlserver://{self.host}:{self.port};" + "".join(f"{k}={v};" for k, v in parts.items() if v is not None)

    def properties(self) -> dict[str, str]:
        return {"user": self.user, "password": self.password}
