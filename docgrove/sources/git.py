"""Git sources: input rules, clone directories and staging; the network step is outside any query."""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import subprocess
from dataclasses import dataclass

# What a host, repository and branch may look like.
HOST = re.compile(r"[a-zA-Z0-9.-]+(:\d+)?")
REPOSITORY = re.compile(r"[a-zA-Z0-9._-]+(/[a-zA-Z0-9._-]+)+")
BRANCH = re.compile(r"[a-zA-Z0-9._/-]+")


@dataclass(frozen=True)
class Provider:
    name: str
    default_host: str
    user: str
    prefix: str
    token_name: str


GITHUB = Provider("GitHub", "github.com", "x-access-token", "github-", "GITHUB_TOKEN")
GITLAB = Provider("GitLab", "gitlab.com", "oauth2", "gitlab-", "GITLAB_TOKEN")


def validate(host: str, repository: str, branch: str) -> None:
    checks = (("host", host, HOST), ("repository", repository, REPOSITORY), ("branch", branch, BRANCH))
    for what, value, rule in checks:
        if not rule.fullmatch(value) or value.startswith("-") or (what == "repository" and ".." in value):
            raise ValueError(f"invalid {what}: {value!r}")


def clone_url(provider: Provider, host: str, repository: str, token: str | None = None) -> str:
    return f"https://{f'{provider.user}:{token}@' if token else ''}{host}/{repository}.git"


def clone_dir(provider: Provider, host: str, repository: str) -> str:
    """A directory name that differs for every (host, repository)."""
    digest = hashlib.sha256(f"{host}\n{repository}".encode()).hexdigest()[:8]
    return f"{provider.prefix}{re.sub('[^a-zA-Z0-9._-]', '-', repository)}-{digest}"


def stage(provider: Provider, host: str, repository: str, branch: str, into: str, token: str | None = None, run=subprocess.run) -> str:
    """A shallow clone, or the default branch if `branch` is missing; the token never stays on disk.

    A clone that is there is brought up to date, or made anew if that fails.
    """
    validate(host, repository, branch)
    target, url = f"{into}/{clone_dir(provider, host, repository)}", clone_url(provider, host, repository, token)
    git = lambda *args, **more: run(["git", *args], capture_output=True, **more)
    known = os.path.isdir(target) and not git("-C", target, "fetch", "--depth", "1", url, branch).returncode and not git("-C", target, "reset", "--hard", "FETCH_HEAD").returncode
    if not known:
        shutil.rmtree(target, ignore_errors=True)
        if git("clone", "--depth", "1", "--branch", branch, "--", url, target).returncode:
            shutil.rmtree(target, ignore_errors=True)
            if git("clone", "--depth", "1", "--", url, target).returncode:
                hint = "the token may lack read access" if token else f"a private one needs {provider.token_name}"
                raise RuntimeError(f"{repository} cannot be cloned: {hint}")
    try:
        bare = clone_url(provider, host, repository)
        run(["git", "-C", target, "remote", "set-url", "origin", bare], capture_output=True, check=True)
        seen = run(["git", "-C", target, "remote", "get-url", "origin"], capture_output=True, check=True).stdout.decode().strip()
        if seen != bare:
            raise RuntimeError("the remote still holds credentials")
    except Exception:
        shutil.rmtree(target, ignore_errors=True)
        raise
    return target
