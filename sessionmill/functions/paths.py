"""Project paths: normal form, last segment, deep links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_DISTRO = "Ubuntu"


def normalize_project(path: Column) -> Column:
    """Equal spelling for one directory seen from Windows and from WSL."""
    slashed = F.lower(F.translate(path, "\\", "/"))
    trimmed = F.rtrim(slashed, F.lit("/"))
    # only slashes: one is kept
    p = F.when((trimmed == "") & (slashed != ""), F.lit("/")).otherwise(trimmed)
    share = r"(?s)^//wsl(?:\$|\.localhost)/[^/]*(/.*)$"
    mount = r"(?s)^/mnt/([A-Za-z])(/.*)$"
    return (
        F.when(p.rlike(share), F.regexp_extract(p, share, 1))
        .when(p.rlike(mount), F.concat(F.regexp_extract(p, mount, 1), F.lit(":"), F.regexp_extract(p, mount, 2)))
        .otherwise(p)
    )


def project_name(path: Column) -> Column:
    """Last non-empty segment, the path itself when there is none."""
    parts = F.filter(F.split(path, r"[/\\]"), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), path)


def alert_project(path: Column) -> Column:
    """Last segment; the whole path when it ends with a separator."""
    last = F.try_element_at(F.split(path, r"[/\\]"), F.lit(-1))
    return F.when(last != "", last).otherwise(path)


def encode_path(path: Column) -> Column:
    """Percent-encode everything but letters, digits and ``/ : - . _ ~``."""
    out = F.url_encode(path)
    for found, wanted in ((r"\+", "%20"), (r"\*", "%2A"), ("%2F", "/"), ("%3A", ":"), ("%7E", "~")):
        out = F.regexp_replace(out, found, wanted)
    return out


def _in_wsl(machine: Column, path: Column) -> Column:
    return (machine != "windows") & path.startswith("/")


def editor_link(machine: Column, path: Column, distro: str = DEFAULT_DISTRO) -> Column:
    return F.when(
        _in_wsl(machine, path), F.concat(F.lit(f"vscode://vscode-remote/wsl+{distro}"), encode_path(path))
    ).otherwise(F.concat(F.lit("vscode://file/"), encode_path(F.translate(path, "\\", "/"))))


def terminal_path(machine: Column, path: Column, distro: str = DEFAULT_DISTRO) -> Column:
    return F.when(
        _in_wsl(machine, path), F.concat(F.lit(f"\\\\wsl.localhost\\{distro}"), F.translate(path, "/", "\\"))
    ).otherwise(path)
