"""What a target of an analysis names: a git address, a host's shorthand, a project."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Schemes and hosts that mark a git address.
SCHEMES = ("https://", "http://", "git@", "ssh://")
HOSTS = ("github.com/", "gitlab.com/", "bitbucket.org/", "codeberg.org/", "sr.ht/")
SHORTHAND_HOST = "https://github.com/"
NAME = r"[a-zA-Z0-9][a-zA-Z0-9._-]*"


@dataclass(frozen=True)
class Repository:
    """A repository: its path with host, its short name, and where to clone it."""

    canonical: str
    name: str
    clone_url: str


def is_git_url(target: str) -> bool:
    return target.startswith(SCHEMES)


def is_host_path(target: str) -> bool:
    """A known host and what follows, without a scheme."""
    return any(target.startswith(h) and target[len(h) :][:1] not in ("", "/") for h in HOSTS)


def is_shorthand(target: str) -> bool:
    """``owner/name`` without a host."""
    return not is_host_path(target) and re.fullmatch(f"{NAME}/{NAME}", target) is not None


def is_project_name(target: str) -> bool:
    return re.fullmatch(NAME, target) is not None


def split_ref(target: str) -> tuple[str, str]:
    """Target and the branch or tag after the last '@'; addresses have none."""
    if target.startswith("git@") or "://" in target:
        return target, ""
    base, at, ref = target.rpartition("@")
    return (base, ref) if at and base and ref else (target, "")


def clone_url(target: str) -> str:
    """The address that a host path or a shorthand stands for; others as they are."""
    return f"https://{target}" if is_host_path(target) else SHORTHAND_HOST + target if is_shorthand(target) else target


def parse(url: str, branch: str = "") -> Repository:
    """The repository of an address; ValueError if it isn't one of host and path."""
    scheme = next((s for s in SCHEMES if url.startswith(s)), None)
    if scheme is None:
        raise ValueError(f"unsupported URL format: {url!r}")
    rest = url[len(scheme) :]
    if scheme == "git@":
        rest = rest.replace(":", "/", 1)
    elif scheme == "ssh://" or "@" in rest.split("/", 1)[0]:
        rest = rest.partition("@")[2] or rest
    path = rest.removesuffix(".git").rstrip("/")
    if "/" not in path:
        raise ValueError(f"invalid repository URL: need at least host/path, got {path!r}")
    ref = f"@{branch}" if branch else ""
    return Repository(path + ref, "/".join(path.split("/")[-2:]) + ref, url)
